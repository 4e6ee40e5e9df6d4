"""Chat formatting: transcripts of other hands, texts that look like markers, blank lines, crowded turns."""

import json
import random

import pytest
from ragloom.llm import chat, common


def prose(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def model():
    rng, examples = random.Random(1), []
    for key in range(400):
        turns = [("system", prose(rng, 12))] * (key % 3 == 0)
        for _ in range(rng.randint(1, 4)):
            answer = "\n".join(prose(rng, rng.randint(8, 60)) for _ in range(rng.choice([1, 1, 2, 3])))
            turns += [("user", prose(rng, 9) + rng.choice(["?", "?", "."])), ("assistant", answer.replace("\n", "\n\n", 1) if key % 10 == 0 else answer)]
        text, states = chat.write_transcript(key, turns)
        examples.append((chat.observe(text)[1], chat.np.array(states)))
    return chat.train(examples)


#: Written by hand, in ways that write_transcript does not use (fixed texts).
FOREIGN = [
    ("Human: What is a shard?\n\nAssistant: A part of an index.\nIt is kept on one machine.\n\nHuman: And a replica?\nAssistant: Its copy.", [("user", "What is a shard?"), ("assistant", "A part of an index.\nIt is kept on one machine."), ("user", "And a replica?"), ("assistant", "Its copy.")]),
    ("SYSTEM: Be brief.\nUSER: Which port?\nASSISTANT: 8080.", [("system", "Be brief."), ("user", "Which port?"), ("assistant", "8080.")]),
    ("Q: How do I stop it?\nA: Press the key.\n\nThen wait.\nQ: How long?\nA: A minute.", [("user", "How do I stop it?"), ("assistant", "Press the key.\n\nThen wait."), ("user", "How long?"), ("assistant", "A minute.")]),
    ("<|user|>\nList the options.\n<|assistant|>\nA: the first\nB: the second\n<|user|>\nThanks", [("user", "List the options."), ("assistant", "A: the first\nB: the second"), ("user", "Thanks")]),
    ("### User\nShow the file\n### Assistant\nuser: root\nshell: sh\n\n### User\nGood", [("user", "Show the file"), ("assistant", "user: root\nshell: sh"), ("user", "Good")]),
    ("Customer: my order is late\nBot: I am sorry.\nCustomer: when will it come?\nBot: Tomorrow", [("user", "my order is late"), ("assistant", "I am sorry."), ("user", "when will it come?"), ("assistant", "Tomorrow")]),
]


@pytest.mark.parametrize("text, turns", FOREIGN)
def test_transcripts_of_other_hands(model, text, turns):
    assert chat.parse(model, text) == turns
    assert [json.loads(x) for x in chat.render(turns).split("\n")] == [{"role": r, "content": c} for r, c in turns]


def test_text_that_begins_like_a_marker_is_kept(model):
    for key in range(12):
        turns = [("user", "A: first"), ("assistant", "User: no, this is text\nmore"), ("user", "then what?")]
        text, states = chat.write_transcript(key, turns)
        assert len(states) == len(chat.observe(text)[0])
        found = chat.parse(model, text)
        assert found[0][1].startswith("A: first") or found[0] == ("user", "A: first"), (key, found)
    assert chat.parse(model, None) == [] and chat.parse(model, " \n ") == []


def test_turns_are_recovered_and_disagreement_is_reported(spark):
    rng, rows = random.Random(2), []
    for c in range(150):
        for i in range(rng.randint(1, 4)):
            rows += [(c, 2 * i, "user", prose(rng, 9) + "?", "old"), (c, 2 * i + 1, "assistant", prose(rng, 40) + ("\n\n" + prose(rng, 40) if rng.random() < 0.1 else ""), "old")]
    rows += [(900, 0, None, None, ""), (901, 0, "user", "where is it?", ""), (901, 0, "user", "where is it?", ""), (None, 0, "user", "y", ""), (902, None, "tool", "z", "")]
    rows += [(903, i, "user" if i % 2 == 0 else "assistant", prose(rng, 9), "") for i in range(1100)]
    out = chat.parsed_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, rendered string")).collect()
    by_conversation = {}
    for r in out:
        by_conversation.setdefault(r["conv_id"], []).append(r)
    assert len(by_conversation[903]) == 3 and len(by_conversation) == 155
    usual = [r for r in out if r["conv_id"] is not None and r["conv_id"] < 150]
    assert sum(r["recovered"] for r in usual) >= 0.9 * len(usual)
    assert all(0 <= r["agreement"] <= 1 for r in out) and by_conversation[901][0]["n_turns"] == 1
    for r in usual:
        if r["recovered"]:
            assert r["n_turns"] == sum(x[0] == r["conv_id"] for x in rows)


def test_crowded_turns_are_transcripts_of_their_own(spark, monkeypatch):
    rows = [(1, 0, "user", f"text {i}") for i in range(200)] + [(1, 1, "assistant", "one")] + [(2, 0, "user", f"text {i}") for i in range(3)] + [(1, 0, "user", "text 5")] * 9
    conversations = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    sizes = lambda: sorted(len(r["turns"]) for r in chat.transcripts(conversations).collect())
    assert sizes() == [1] * 201 + [3]
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert sizes() == [1] * 201 + [3]
