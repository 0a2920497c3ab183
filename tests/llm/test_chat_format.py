"""Chat formatting: layouts, round trips, loss masks."""
import hashlib
import json
import random

from pyspark.sql import functions as F

from replenish.llm import chat_format as C


def rendered(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    records = df.select("conv_id", F.to_json(F.struct("turn", "role", "text")).alias("json"))
    return C.render(C.canonical_turns(records.withColumns({"turn": F.lit("x"), "record": F.lit(1)}) if extra else records))


def test_round_trip_and_mask(spark):
    rng = random.Random(9)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "/", "s>", "INST]", "\n", " ", "a", "é😀", "%", "<\\s>", "[\\\\/INST]", "</s", "\u2028", "\x00", "\"", "\t"]
    text = lambda: "".join(rng.choice(bits) for _ in range(rng.randrange(0, 14)))
    rows = []
    for c in range(120):
        for t in range(rng.randrange(1, 6)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "tool%\n<s>", "", None]), rng.choice([text(), text(), text(), None])))
    rows += [(None, 0, "user", "null id"), (None, None, "assistant", None), (500, 1, "assistant", "x" * 50000), (500, 1, "assistant", "x" * 50000), (501, None, None, None)]
    out = rendered(spark, rows)
    back = {r.conv_id: r for r in out.select("conv_id", "formatted", "loss_mask", C.parse(F.col("formatted")).alias("turns")).collect()}
    digests = {r.conv_id: r for r in C.digest_formatted(out).collect()}
    groups = {}
    for c, t, role, x in rows:
        groups.setdefault(c, []).append((t is not None, t or 0, role or "", x or ""))
    assert set(back) == set(groups)
    for c, turns in groups.items():
        turns.sort()
        got = back[c]
        assert [(t.role, t.text) for t in got.turns] == [(r, x) for _, _, r, x in turns]
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        assert len(got.loss_mask) == sum(r == "assistant" for _, _, r, _ in turns)
        d = digests[c]
        assert (d.n_turns, d.loss_chars, d.formatted_chars) == (len(turns), len(loss), len(got.formatted))
        assert d.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert d.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()).hexdigest()


def test_layouts(spark):
    records = [
        (1, {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}], "meta": {"x": 1}}),
        (2, {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}),
        (3, {"prompt": "a", "completion": "b"}), (4, {"system": "s", "prompt": "a", "completion": "b", "text": None}),
        (5, {"instruction": "a", "input": "", "output": "b"}), (6, {"instruction": "a", "input": "i", "output": "b", "source": "z"}),
        (7, {"instruction": "a"}), (8, {"turn": 0, "role": "user", "text": "a"}), (8, {"turn": 1, "role": "assistant", "text": "b", "score": 0.5}),
        (9, {"unknown": 1, "messages": None, "prompt": "a", "messages_": []}), (10, {"prompt": "a", "instruction": "b"}),
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in records], "conv_id long, json string")
    got = {}
    for r in C.canonical_turns(df).orderBy("conv_id", "turn").collect():
        got.setdefault((r.conv_id, r.layout), []).append((r.role, r.text))
    assert got.pop((10, None)) == [(None, None)]
    ab = [("user", "a"), ("assistant", "b")]
    assert got == {(1, "messages"): ab, (2, "from_value"): ab, (3, "prompt"): ab, (4, "prompt"): [("system", "s"), *ab], (5, "instruction"): ab,
                   (6, "instruction"): [("user", "a\ni"), ("assistant", "b")], (7, "instruction"): ab[:1], (8, "turn"): ab, (9, "prompt"): ab[:1]}
    known = {r.paths: (r.layout, r.records) for r in C.fingerprints(df).collect()}
    assert known["OBJECT<instruction, prompt>"] == (None, 1) and known["OBJECT<completion, prompt>"] == ("prompt", 1)
    assert sum(n for _, n in known.values()) == len(records)


def test_no_record_is_lost_or_invented(spark):
    ab = [("user", "a"), ("assistant", "b")]
    lists = [{"role": "user", "content": "a"}, None, {"role": "assistant", "content": "b"}]
    cases = [
        # surplus and optional fields
        ({"messages": lists, "system": "s", "id": 3}, "messages", [("system", "s"), *ab]),
        ({"conversations": [{"from": "human", "value": "a", "w": 1}, {"from": "gpt", "value": "b"}], "system": "s"}, "from_value", [("system", "s"), *ab]),
        ({"instruction": "a", "input": "", "output": "b", "text": "Below is"}, "instruction", ab),
        ({"prompt": "a", "completion": "b", "role": "x", "turn": 4}, "prompt", ab),
        # null texts are empty
        ({"messages": [{"role": "user", "content": None}]}, "messages", [("user", "")]),
        ({"messages": [{"content": "a"}]}, "messages", [("", "a")]),
        ({"role": "user", "text": None}, "turn", [("user", "")]), ({"turn": None, "role": None}, "turn", [("", "")]), ({}, "turn", [("", "")]),
        # no layout: one row each
        *[(x, None, [(None, None)]) for x in ({"foo": 1}, {"messages": []}, {"messages": None}, {"messages": [{}]}, {"messages": [{"role": None}]},
                                              {"conversations": [], "messages": []}, {"system": "s"}, {"prompt": "a", "messages": lists}, None,
                                              '{"prompt": "a', "not json", "", "[1, 2]", "7", '"text"')],
    ]
    rows = [(i, x if x is None or isinstance(x, str) else json.dumps(x)) for i, (x, _, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "conv_id long, json string")
    got = {}
    for r in C.canonical_turns(df).orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, (r.layout, []))[1].append((r.role, r.text))
    for i, (x, layout, turns) in enumerate(cases):
        assert got[i] == (layout, turns), (x, got[i])
    out = {r.conv_id: r for r in C.digest_formatted(C.render(C.canonical_turns(df))).collect()}
    assert len(out) == len(cases)
    for i, (_, layout, turns) in enumerate(cases):
        assert out[i].n_turns == (len(turns) if layout else 0) and (layout or out[i].formatted_chars == 0)
    assert sum(r.records for r in C.fingerprints(df).collect()) == len(cases)


def test_empty_table(spark):
    assert C.digest_formatted(rendered(spark, [], False)).collect() == []
