"""Operators for preparing training data at scale. Nothing else in ragloom imports this subpackage."""
