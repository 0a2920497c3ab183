"""Chat formatting by schema fingerprints.

Records come as JSON in several layouts (one turn, a message list, from/value pairs, prompt and completion,
instruction and output). Each record is projected to the fields that any layout knows (``FIELDS``) and its nested field
paths are read off as a type string, which is hashed. Of these, the paths that tell layouts apart (``SELECTING``) are hashed
too, and that fingerprint selects one declarative mapping to canonical turns (turn, role, text); all other fields are
optional or surplus and never keep a record from its layout. A record whose paths select no layout, or two that exclude
each other, comes out as one row with a null layout and no turn; ``fingerprints`` counts records by their paths.

Template: a turn is ``<s>role\\nbody</s>``; the body is the text, between ``[INST] `` and `` [/INST]`` for every role but
assistant. The control strings ``<s> </s> [INST] [/INST]`` inside a text get a backslash after their first character
(one more if some are there), which ``unescape`` takes away; a role has ``% < line feed`` percent-encoded. The loss mask
lists the spans (start, len; code points from 0) of the assistants' texts.

Defined results: null text and null role are empty; a null or malformed record, one without known fields and one whose
lists are empty or hold no field has a null layout (the empty object is a turn: what a
writer that drops nulls leaves of one without any value), and a conversation of such records alone is formatted as the empty text;
null entries of a list are left out; a null conv_id is one conversation; turns are ordered by (turn,
role, text), null first, so repeated rows stay and ties are stable; an empty table gives an empty result; columns other
than the named ones never matter. A conversation is one output row by nature, so it has to fit in one. Only DataFrame
and SQL functions are used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: All fields that some layout reads.
FIELDS = ("turn BIGINT, role STRING, text STRING, messages ARRAY<STRUCT<role: STRING, content: STRING>>, "
          "conversations ARRAY<STRUCT<`from`: STRING, value: STRING>>, system STRING, prompt STRING, completion STRING, "
          "instruction STRING, input STRING, output STRING")

_TURN = "array<struct<turn:bigint,role:string,text:string>>"


def _turn(i, role, text) -> Column:
    i = F.lit(i) if isinstance(i, int) else i
    return F.struct(i.cast("long").alias("turn"), F.coalesce(F.lit(role) if isinstance(role, str) else role, F.lit("")).alias("role"),
                    F.coalesce(text, F.lit("")).alias("text"))


def _given(*turns: tuple[str, Column]) -> Column:
    """The turns whose text is given, numbered in order."""
    made = F.array(*[F.when(t.isNotNull(), _turn(i, r, t)) for i, (r, t) in enumerate(turns)])
    return F.filter(made, lambda x: x.isNotNull())


#: The field paths that select a layout, as patterns of the type string.
SELECTING = {"messages": r"[<,] ?messages: ARRAY<OBJECT<\w", "from_value": r"[<,] ?conversations: ARRAY<OBJECT<\w",
             "prompt": r"[<,] ?prompt[,>]", "instruction": r"[<,] ?instruction[,>]"}
#: The fields of a single turn; one of them selects it, even if it is null.
TURN = ("role", "text", "turn")


def _mappings() -> dict[str, Column]:
    """Layout to the mapping of its records to turns."""
    r = lambda f: F.col(f"record.{f}")
    sender = {"human": "user", "gpt": "assistant"}
    name = lambda c: F.coalesce(*[F.when(c == k, v) for k, v in sender.items()], c)
    asked = F.when(F.coalesce(r("input"), F.lit("")) == "", r("instruction")).otherwise(F.concat(r("instruction"), F.lit("\n"), r("input")))

    def listed(items: Column, role, text) -> Column:
        first = F.when(r("system").isNotNull(), 1).otherwise(0)
        turns = F.transform(F.filter(items, lambda m: m.isNotNull()), lambda m, i: _turn(first + i, role(m), text(m)))
        return F.concat(_given(("system", r("system"))), turns)

    return {
        "turn": F.array(_turn(r("turn"), r("role"), r("text"))),
        "messages": listed(r("messages"), lambda m: m["role"], lambda m: m["content"]),
        "from_value": listed(r("conversations"), lambda m: name(m["from"]), lambda m: m["value"]),
        "prompt": _given(("system", r("system")), ("user", r("prompt")), ("assistant", r("completion"))),
        "instruction": _given(("system", r("system")), ("user", asked), ("assistant", r("output"))),
    }


def field_paths(record: Column) -> Column:
    """The nested field paths of a record (a struct; null fields don't count), scalar types left out."""
    kinds = F.schema_of_variant(F.parse_json(F.to_json(record, {"ignoreNullFields": "true"})))
    return F.regexp_replace(kinds, r"(: |(?<=ARRAY<))(?!ARRAY<|OBJECT<)[A-Z][A-Z0-9_]*(\([0-9, ]*\))?", "")


def signatures() -> dict[str, str]:
    """Selecting paths, joined, to layout: any one of the first four, with or without those of a single turn, or the latter
    alone."""
    return {"turn": "turn", **{n: n for n in SELECTING}, **{f"{n},turn": n for n in SELECTING}}


def _fingerprint(paths: Column) -> Column:
    return F.xxhash64(paths)


def _layout(json: Column, paths: Column) -> Column:
    """The layout that the fingerprint of the selecting paths stands for, null for none."""
    keys = F.json_object_keys(json)
    one = (F.size(keys) == 0) | F.arrays_overlap(keys, F.array(*map(F.lit, TURN)))
    selecting = F.concat_ws(",", *[F.when(paths.rlike(p), F.lit(n)) for n, p in SELECTING.items()], F.when(one, F.lit("turn")))
    table = F.create_map(*[x for p, n in signatures().items() for x in (_fingerprint(F.lit(p)), F.lit(n))])
    return F.try_element_at(table, _fingerprint(selecting))


def canonical_turns(records: DataFrame) -> DataFrame:
    """(conv_id, json) to (conv_id, layout, turn, role, text); a record without a layout is one row of nulls."""
    parsed = (records.select("conv_id", "json", F.from_json("json", FIELDS).alias("record"))
              .withColumn("layout", _layout(F.col("json"), field_paths(F.col("record")))))
    turns = F.lit(None).cast(_TURN)
    for name, mapping in _mappings().items():
        turns = F.when(F.col("layout") == name, mapping).otherwise(turns)
    return (parsed.select("conv_id", "layout", F.explode_outer(turns).alias("t"))
            .select("conv_id", "layout", "t.turn", "t.role", "t.text"))


def fingerprints(records: DataFrame) -> DataFrame:
    """Records by field paths: paths, fingerprint, layout (null: no mapping), records."""
    paths = field_paths(F.from_json("json", FIELDS))
    return (records.select(paths.alias("paths"), _layout(F.col("json"), paths).alias("layout")).groupBy("paths", "layout").agg(F.count("*").alias("records"))
            .select("paths", _fingerprint(F.col("paths")).alias("fingerprint"), "layout", "records"))


_CONTROL = r"(/?(?:s>|INST\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*){_CONTROL}", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*){_CONTROL}", "$1$2$3")


def _swap(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


_ROLE = [("%", "%25"), ("\n", "%0A"), ("<", "%3C")]


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) to one row per conversation: conv_id, formatted, loss_mask array<struct<start, len>>. Rows
    without a role and a text (records without a layout) are no turns."""
    role, text = _swap(F.col("role"), _ROLE), escape(F.col("text"))
    head, tail = F.concat(F.lit("<s>"), role, F.lit("\n")), F.lit("</s>")
    said = F.col("role") == "assistant"
    body = F.when(said, text).otherwise(F.concat(F.lit("[INST] "), text, F.lit(" [/INST]")))
    parts = turns.select("conv_id", F.when(F.col("role").isNotNull() & F.col("text").isNotNull(), F.struct("turn", "role", "text", F.concat(head, body, tail).alias("out"), F.char_length(head).alias("head"),
                                             F.when(said, F.char_length(text)).alias("loss"))).alias("t"))
    grouped = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,len:int>>").alias("mask"))
    mask = F.aggregate("t", start, lambda a, x: F.struct(
        (a["at"] + F.char_length(x["out"])).alias("at"),
        F.when(x["loss"].isNull(), a["mask"]).otherwise(F.concat(a["mask"], F.array(F.struct(
            (a["at"] + x["head"]).alias("start"), x["loss"].alias("len"))))).alias("mask")), lambda a: a["mask"])
    return grouped.select("conv_id", F.array_join(F.transform("t", lambda x: x["out"]), "").alias("formatted"), mask.alias("loss_mask"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation, unescaped: array<struct<role, text>>."""
    parts = F.filter(F.split(formatted, "</s>"), lambda s: s != "")

    def turn(s):
        raw = F.substring_index(F.substring(s, 4, 2**31 - 1), "\n", 1)
        body = F.substring(s, F.char_length(raw) + 5, F.lit(2**31 - 1))
        text = F.when(raw == "assistant", body).otherwise(F.substring(body, F.lit(8), F.char_length(body) - 15))
        return F.struct(_swap(raw, [(b, a) for a, b in reversed(_ROLE)]).alias("role"), unescape(text).alias("text"))

    return F.transform(parts, turn)


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substring(formatted, (m["start"] + 1).cast("int"), m["len"]))), "")


def digest_formatted(rendered: DataFrame) -> DataFrame:
    """What can be read back from ``render``'s output."""
    read = rendered.select("conv_id", parse(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("loss_mask")).alias("loss"),
                           F.char_length("formatted").cast("long").alias("formatted_chars"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
                       F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
