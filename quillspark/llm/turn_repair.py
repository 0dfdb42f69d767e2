"""Conversation structure repair: the cheapest edits that make roles read `(s?(ua)+)?`.

Window functions flag each turn's first fault; blocks of sorted turn structs are folded by
aggregate(), which carries one (cost, audit) struct for each of the four states of that
pattern; a second fold joins the blocks of a conversation. Nothing but built-in functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"
_STATES = "esua"  # nothing yet; after a system, user or assistant turn
_BEST = "struct<cost:bigint,audit:string>"
_VECTOR = f"struct<{','.join(f'{s}:{_BEST}' for s in _STATES)}>"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5  # costs; the last is added to a truncated turn that stays


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """rows with planted faults, by crc32(`conv:turn`) % 20: 0 drops a row, 1 empties its text, 2
    removes `[.!?]`, 3 repeats the row, 4 sets role user. Nulls of the key, role and text are one
    space; a null turn stays null. Returns these four columns; others are not read."""
    shown = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv, turn, role, text)}
    kind = F.crc32(F.concat(shown[conv], F.lit(":"), shown[turn]).cast("binary")) % 20
    told = F.when(kind == 1, "").when(kind == 2, F.translate(shown[text], ".!?", "")).otherwise(shown[text])
    out = rows.select(F.col(conv), F.col(turn), F.when(kind == 4, "user").otherwise(shown[role]).alias(role), told.alias(text), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("__copies"))
    return out.select("*", F.explode(F.array_repeat(F.lit(True), F.col("__copies")))).select(conv, turn, role, text)


def _least(*choices: Column) -> Column:
    """The cheapest; ties to the ASCII-least audit. Null: out of reach."""
    return F.least(*choices)


def _edited(state: Column, cost: Column | int, letter: Column | str) -> Column:
    letter = F.lit(letter) if isinstance(letter, str) else letter
    return F.when(state.isNotNull(), F.struct((state["cost"] + cost).cast("long").alias("cost"), F.concat(state["audit"], letter).alias("audit")))


def _with_inserts(v: Column) -> tuple[Column, Column, Column, Column]:
    """The states once turns may have been inserted: a user turn after any state but user, and an
    assistant turn after that. More never pays: it would come back to a state for a higher cost."""
    user = _least(v["u"], *(_edited(v[s], INSERT, "I") for s in "esa"))
    return v["e"], v["s"], user, _least(v["a"], _edited(user, INSERT, "I"))


def _step(v: Column, turn: Column) -> Column:
    """The four states after one more turn. A turn that is kept or gets a new role goes through
    the least of the states that allow it: audits of one cost over the same turns are never
    prefixes of each other (their letters give the cost), so the least one stays least."""
    e, s, u, a = _with_inserts(v)
    stays, extra = ~turn["gone"], F.when(turn["cut"], TRUNCATED).otherwise(0)

    def kept(state: Column, initial: str) -> Column:
        own = turn["initial"] == initial
        return F.when(stays, _edited(state, extra + F.when(own, KEEP).otherwise(REROLE), F.when(own, "K").otherwise("R")))

    system = F.when(stays & (turn["initial"] == "s"), _edited(e, extra + KEEP, "K"))
    return F.struct(
        _edited(e, DELETE, "D").alias("e"),
        _least(_edited(s, DELETE, "D"), system).alias("s"),
        _least(_edited(u, DELETE, "D"), kept(_least(e, s, a), "u")).alias("u"),
        _least(_edited(a, DELETE, "D"), kept(u, "a")).alias("a"),
    ).cast(_VECTOR)


def _start(state: Column | str) -> Column:
    """Only this state, at no cost."""
    nothing = F.struct(F.lit(0).cast("long").alias("cost"), F.lit("").alias("audit"))
    return F.struct(*(F.when(F.lit(s) == state, nothing).alias(s) for s in _STATES)).cast(_VECTOR)


def _joined(v: Column, block: Column) -> Column:
    """The states after a block, whose edits from each state are known."""

    def through(i: int, to: str) -> Column:
        before, after = v[_STATES[i]], block["from"][i][to]
        return F.when(before.isNotNull() & after.isNotNull(), F.struct((before["cost"] + after["cost"]).alias("cost"), F.concat(before["audit"], after["audit"]).alias("audit")))

    return F.struct(*(_least(*(through(i, to) for i in range(4))).alias(to) for to in _STATES)).cast(_VECTOR)


def repair(rows: DataFrame, all_ids: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = 256) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, turns): a row per conversation.

    Turns are ordered by turn (nulls first), then role and text. turns is the repaired
    conversation as array<struct<edit, role, text>>; audit has a letter per edit: K keep,
    R new role (user or assistant), D delete, I insert an empty one. Deleted are all blank
    and repeated turns (role and text seen earlier), and others where that is cheaper.
    Ties go to the ASCII-least audit. all_ids: a table with column conv, whose ids all get
    a row, if need be with zeros and nothing repaired.

    Null role and text read as one space, so such text is blank; a role that begins with
    none of s, u, a can't be kept. A null conversation id is a conversation. Repeated rows
    are duplicates. Other columns are not read. An empty table gives an empty result.

    A conversation is cut by `block` turn numbers, and where one number has more rows, into
    blocks of so many rows; blocks are folded apart from each other, from every state. One
    conversation's blocks meet only in its own result, which holds all its text in any case.
    """
    given = rows.select(F.col(conv).alias("c"), F.col(turn).cast("long").alias("t"), F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"))
    earlier = Window.partitionBy("c", "role", "text").orderBy(F.asc_nulls_first("t"))
    flagged = given.withColumn("seen", F.row_number().over(earlier) > 1)
    body = F.rtrim("text", F.lit(WHITE))
    ended = reduce(lambda x, y: x | y, (F.endswith(body, F.lit(x)) for x in ".!?"))
    fault = F.when(body == "", "blank").when(F.col("seen"), "duplicate").when(~ended, "truncated").otherwise("")
    part = F.shiftright("t", block.bit_length() - 1)
    in_part = Window.partitionBy("c", "part").orderBy(F.asc_nulls_first("t"), "role", "text", "seen")
    numbered = flagged.select("c", "t", "role", "text", "seen", part.alias("part"), fault.alias("fault")).withColumn("n", F.row_number().over(in_part))
    one = F.struct("n", "t", "role", "text", "fault", F.substring("role", 1, 1).alias("initial"), F.col("fault").isin("blank", "duplicate").alias("gone"), (F.col("fault") == "truncated").alias("cut"))
    blocks = numbered.groupBy("c", "part", F.floor((F.col("n") - 1) / block).alias("sub")).agg(F.array_sort(F.collect_list(one)).alias("turns"))
    states = F.array(*(F.lit(s) for s in _STATES))
    blocks = blocks.withColumn("from", F.transform(states, lambda s: F.aggregate("turns", _start(s), _step)))
    blocks = blocks.select("c", F.struct("part", "sub", "turns", "from").alias("block"))
    if all_ids is not None:
        blocks = blocks.unionByName(all_ids.select(F.col(conv).alias("c")).distinct(), allowMissingColumns=True)
    whole = blocks.groupBy("c").agg(F.sort_array(F.collect_list("block")).alias("blocks"))
    whole = whole.select("c", F.flatten(F.transform("blocks", lambda b: b["turns"])).alias("old"), F.aggregate("blocks", _start("e"), _joined).alias("v"))
    e, _, _, a = _with_inserts(F.col("v"))
    whole = whole.select("c", "old", _least(e, a).alias("best")).select("c", "old", F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"))
    numbers = F.filter(F.transform("old", lambda t: t["t"]), lambda t: t.isNotNull())
    gaps = F.coalesce(F.array_max(numbers) - F.array_min(numbers) + 1 - F.size(F.array_distinct(numbers)), F.lit(0)).cast("long")
    faults = F.transform("old", lambda t: t["fault"])
    counts = [(F.size("old") - F.size(F.array_remove(faults, k))).cast("long").alias(k) for k in ("blank", "duplicate", "truncated")]
    initials = F.transform("old", lambda t: t["initial"])
    pairs = F.zip_with(F.slice(initials, 1, F.greatest(F.size("old") - 1, F.lit(0))), F.slice(initials, 2, F.size("old")), lambda x, y: F.concat(x, y).isin("su", "ua", "au"))
    illegal = F.size(F.filter(pairs, lambda ok: ~ok)).cast("long")
    return whole.select(F.col("c").alias(conv), gaps.alias("gaps"), *counts, illegal.alias("illegal"), "cost", "audit", _repaired(F.col("old"), F.col("audit")).alias("turns"))


def _repaired(old: Column, audit: Column) -> Column:
    """The turns that the audit's letters leave. Each old turn has the letters up to its own;
    the place among the turns that stay gives user or assistant."""
    new = F.struct(F.lit("I").alias("edit"), F.lit("").alias("role"), F.lit("").alias("text"))
    inserted = lambda n: F.array_repeat(new, n)
    own = F.regexp_extract_all(audit, F.lit("(I*[KRD])"), F.lit(1))

    def stays(t: Column, letters: Column) -> Column:
        edit = F.substring(letters, -1, 1)
        kept = F.array(F.struct(edit.alias("edit"), t["role"].alias("role"), t["text"].alias("text")))
        return F.concat(inserted(F.length(letters) - 1), F.when(edit != "D", kept).otherwise(F.slice(kept, 1, 0)))

    last = inserted(F.length(F.regexp_extract(audit, "I*$", 0)))
    turns = F.concat(F.flatten(F.zip_with(old, own, stays)), last)
    led = F.when((F.get(turns, F.lit(0))["edit"] == "K") & F.startswith(F.get(turns, F.lit(0))["role"], F.lit("s")), 1).otherwise(0)

    def named(t: Column, i: Column) -> Column:
        role = F.when(t["edit"] == "K", t["role"]).when((i - led) % 2 == 0, "user").otherwise("assistant")
        return F.struct(t["edit"].alias("edit"), role.alias("role"), t["text"].alias("text"))

    return F.transform(turns, named)


def written(turns: Column) -> Column:
    """`role:text` of each turn, joined by line feeds."""
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
