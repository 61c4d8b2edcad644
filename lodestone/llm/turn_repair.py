"""Repair of conversations whose turns are faulty or out of order, by a fold over the sorted turns.

A conversation should read ``(s?(ua)+)?`` in the first letters of its roles: a system turn or none, then user and assistant by
turns, or nothing at all. Windows flag each turn's first fault: blank, duplicate (role and text seen earlier in the conversation) or
truncated (its last solid character is none of ``.!?``). The turns are collected in order, and ``aggregate`` carries four
(cost, audit) structs over them: the cheapest way to have written nothing, a system turn, a user turn or an assistant turn last. Each step takes
the least struct, so that of equally cheap ways the one of the least audit stays. An audit names the edits in order: K keeps
a turn, R gives it the role that is due (user or assistant), D deletes it, I inserts an empty turn of the role that is due.

A conversation of more than ``TURNS`` turns or ``TEXT_BYTES`` of text does not come together in one row: it is numbered over sorted ranges, blocks of
``BLOCK`` turns are folded from each of the four states to each, and these tables are multiplied in a tree; only single letters and
audits meet, never its texts. Its repaired turns are written as a stream over sorted rows.

Defined results: a null role or text is one space; turns without a number come first; turns of one number stand by role, then text, and of equal ones the first is no duplicate; a turn without a
conversation belongs to one conversation without an id; ``gaps`` is null where the span of turns fits no long; a role's first
letter is compared as it stands, and an empty role has none; a conversation of no turns is none, unless ``there`` says
that its turns were dropped, which gives zeros; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from lodestone.operators.durable import durable, small

#: Turns and bytes of text of a conversation that come together in one row at most.
TURNS, TEXT_BYTES = 4096, 16 << 20
#: Turns of a block of a longer one, and blocks that are multiplied at once.
BLOCK, FAN = 1024, 32
#: What edits cost: giving another role, deleting, inserting, keeping a truncated turn (fixed values).
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
STATES = ["none", "s", "u", "a"]
NEVER = 1 << 40
_SPACE = " \t\n\x0b\x0c\r"
OK, BLANK, DUPLICATE, TRUNCATED = range(4)


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.transform(F.array(value), use)[0]


def _way(way: Column, price: Column | int, letters: Column | str) -> Column:
    letters = F.lit(letters) if isinstance(letters, str) else letters
    return F.struct((way["cost"] + price).cast("long").alias("cost"), F.concat(way["audit"], letters).alias("audit"))


def _ways(none: Column, s: Column, u: Column, a: Column) -> Column:
    return F.struct(none.alias("none"), s.alias("s"), u.alias("u"), a.alias("a"))


def _from(state: str | None = None) -> Column:
    """The ways at the beginning, or from one state alone."""
    at = lambda free: F.struct(F.lit(0 if free else NEVER).cast("long").alias("cost"), F.lit("").alias("audit"))
    return _inserted(_ways(*(at(k == "none") for k in STATES))) if state is None else _ways(*(at(k == state) for k in STATES))


def _inserted(w: Column) -> Column:
    """The ways after up to two insertions; more are never cheaper."""
    none, s, u, a = (w[k] for k in STATES)
    one, two = (lambda x: _way(x, INSERT, "I")), (lambda x: _way(x, 2 * INSERT, "II"))
    return _ways(none, s, F.least(u, one(none), one(s), one(a)), F.least(a, one(u), two(none), two(s)))


def _after(w: Column, turn: Column) -> Column:
    """The ways after one more turn (initial, fault)."""
    none, s, u, a = (w[k] for k in STATES)
    must = turn["fault"].isin(BLANK, DUPLICATE)
    cut = F.when(turn["fault"] == TRUNCATED, CUT).otherwise(0)
    gone = lambda x: _way(x, DELETE, "D")

    def stays(x: Column, due: str) -> Column:
        fits = turn["initial"] == due
        return _way(x, cut + F.when(fits, 0).otherwise(REROLE), F.when(fits, "K").otherwise("R"))

    return _ways(
        gone(none),
        F.when(must | (turn["initial"] != "s"), gone(s)).otherwise(F.least(gone(s), stays(none, "s"))),
        F.when(must, gone(u)).otherwise(F.least(gone(u), stays(none, "u"), stays(s, "u"), stays(a, "u"))),
        F.when(must, gone(a)).otherwise(F.least(gone(a), stays(u, "a"))),
    )


def _fold(turns: Column, start: Column) -> Column:
    return F.aggregate(turns, start, lambda w, turn: _named(_after(w, turn), _inserted))


def _initial(role: Column) -> Column:
    """The first letter of a role if it is one of those that count, else a dash: one letter for every turn."""
    first = F.left(role, F.lit(1))
    return F.when(first.isin("s", "u", "a"), first).otherwise("-")


def _illegal(initials: Column) -> Column:
    """How many neighbours in a string of initials do not follow each other."""
    pairs = F.when(F.length(initials) > 1, F.sequence(F.lit(1), F.length(initials) - 1)).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(pairs, lambda i: ~F.substring(initials, i, F.lit(2)).isin("su", "ua", "au"))).cast("long")


def _span(low: Column, high: Column, distinct: Column) -> Column:
    wide = lambda c: c.cast("decimal(20,0)")
    return F.when(low.isNull(), F.lit(0).cast("long")).otherwise((wide(high) - wide(low) + 1 - wide(distinct)).try_cast("long"))


def _prepared(turns: DataFrame, conv: str, turn: str, role: str, text: str, there: str | None) -> DataFrame:
    there = F.col(there) if there else F.lit(True)
    kept = lambda c: F.when(there, F.coalesce(F.col(c), F.lit(" ")))
    return turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), kept(role).alias("role"), kept(text).alias("text"), there.alias("there"))


def _flagged(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` with ``seen``, whether a turn's role and text came earlier, and the first fault of each turn; dropped ones have none."""
    solid = F.rtrim(F.col("text"), F.lit(_SPACE))
    seen = F.row_number().over(Window.partitionBy(*by, "role", "text").orderBy(F.asc_nulls_first("turn"))) > 1
    rows = rows.withColumn("seen", seen)
    fault = F.when(~F.col("there"), OK).when(solid == "", BLANK).when(F.col("seen"), DUPLICATE).when(~F.right(solid, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(OK)
    return rows.withColumn("fault", fault)


def _short(rows: DataFrame) -> DataFrame:
    """One row for each conversation, with its sorted ``turns`` and the ``best`` way. One shuffle: windows and groups share it."""
    flagged = _flagged(rows.repartition("conv"), "conv")
    own = F.struct("turn", "role", "text", "seen", "fault", _initial(F.col("role")).alias("initial"))
    held = flagged.groupBy("conv").agg(F.array_sort(F.collect_list(F.when(F.col("there"), own))).alias("turns"))
    ways = _fold(F.transform("turns", lambda t: F.struct(t["initial"].alias("initial"), t["fault"].alias("fault"))), _from())
    numbers = F.array_compact(F.transform("turns", lambda t: t["turn"]))
    count = lambda fault: F.size(F.filter("turns", lambda t: t["fault"] == fault)).cast("long")
    held = held.withColumns({"best": _named(ways, lambda w: F.least(w["none"], w["a"])), "numbers": numbers, "initials": F.array_join(F.transform("turns", lambda t: t["initial"]), "")})
    return held.select(
        "conv", _span(F.array_min("numbers"), F.array_max("numbers"), F.size(F.array_distinct("numbers"))).alias("gaps"), count(BLANK).alias("blank"), count(DUPLICATE).alias("duplicate"),
        count(TRUNCATED).alias("truncated"), _illegal(F.col("initials")).alias("illegal"), "best.cost", "best.audit", "turns",
    )


def _rewritten(turns: Column, audit: Column) -> Column:
    """(role, text) of the turns that an audit leaves: the letters up to one tell which turn it speaks of, and which role is due."""
    upto = lambda i, letter: F.length(F.replace(F.left(audit, i), F.lit(letter), F.lit("")))
    letters = F.when(F.length(audit) > 0, F.sequence(F.lit(1), F.length(audit))).otherwise(F.array().cast("array<int>"))
    edits = F.transform(letters, lambda i: F.struct(F.substring(audit, i, F.lit(1)).alias("edit"), F.get(turns, upto(i, "I") - 1).alias("turn"), upto(i, "D").alias("place")))
    left = F.filter(edits, lambda e: e["edit"] != "D")
    due = lambda odd: F.when(odd, "user").otherwise("assistant")

    def written(kept: Column) -> Column:
        # the first turn that stays is a system turn, or else a user turn
        ahead = F.when((F.get(kept, F.lit(0))["edit"] == "K") & (F.get(kept, F.lit(0))["turn"]["initial"] == "s"), 1).otherwise(0)
        return F.transform(kept, lambda e: F.struct(
            F.when(e["edit"] == "K", e["turn"]["role"]).otherwise(due((e["place"] - ahead) % 2 == 1)).alias("role"),
            F.when(e["edit"] == "I", "").otherwise(e["turn"]["text"]).alias("text"),
        ))

    return _named(left, written)


def _times(x: Column, y: Column) -> Column:
    """One table of ways after another: from each state to each over all between."""
    def through(i: str, j: str) -> Column:
        return F.least(*(F.struct((x[i][k]["cost"] + y[k][j]["cost"]).alias("cost"), F.concat(x[i][k]["audit"], y[k][j]["audit"]).alias("audit")) for k in STATES))

    return F.struct(*(_ways(*(through(i, j) for j in STATES)).alias(i) for i in STATES))


def _long(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations of ``rows`` as in ``_short``, but without their turns, and the turns (conv, at, role, text, initial) by ``at``, their order."""
    flagged = _flagged(rows.where("there"), "conv").repartitionByRange("conv", F.asc_nulls_first("turn"), "role", "text").sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "text", "seen")
    turns = durable(flagged.select("conv", "turn", "role", "text", "fault", _initial(F.col("role")).alias("initial"), F.monotonically_increasing_id().alias("at")))
    count = lambda fault: F.sum((F.col("fault") == fault).cast("long"))
    totals = turns.groupBy("conv").agg(F.min("turn").alias("low"), F.max("turn").alias("high"), count(BLANK).alias("blank"), count(DUPLICATE).alias("duplicate"), count(TRUNCATED).alias("truncated"))
    numbers = turns.where("turn IS NOT NULL").select("conv", "turn").distinct().groupBy("conv").agg(F.count("*").alias("distinct"))
    blocks = turns.groupBy("conv", F.floor(F.col("at") / BLOCK).alias("b")).agg(F.array_sort(F.collect_list(F.struct("at", "initial", "fault"))).alias("own"))
    table = F.struct(*(_fold(F.col("own"), _from(k)).alias(k) for k in STATES))
    blocks = durable(blocks.select("conv", "b", table.alias("table"), F.array_join(F.transform("own", lambda t: t["initial"]), "").alias("initials")))
    before = F.lag(F.right("initials", F.lit(1))).over(Window.partitionBy("conv").orderBy("b"))
    illegal = blocks.select("conv", _illegal(F.concat(F.coalesce(before, F.lit("")), "initials")).alias("n")).groupBy("conv").agg(F.sum("n").alias("illegal"))
    at = Window.partitionBy("conv").orderBy("b")
    now = blocks.select("conv", (F.row_number().over(at) - 1).alias("b"), "table")
    most = blocks.groupBy("conv").count().agg(F.max("count")).first()[0] or 0
    while True:
        met = now.groupBy("conv", F.floor(F.col("b") / FAN).alias("b")).agg(F.array_sort(F.collect_list(F.struct("b", "table"))).alias("t"))
        same = F.struct(*(_from(k).alias(k) for k in STATES))
        now = met.select("conv", "b", F.aggregate("t", same, lambda x, y: _times(x, y["table"])).alias("table"))
        most = -(-most // FAN)
        if most <= 1:
            break
        now = durable(now)
    whole = _named(_times(F.struct(*(_from().alias(k) for k in STATES)), F.col("table")), lambda t: F.least(t["none"]["none"], t["none"]["a"]))
    found = now.select("conv", whole.alias("best"))
    on = lambda left, right: left.join(right.withColumnRenamed("conv", "_c"), F.col("conv").eqNullSafe(F.col("_c")), "left").drop("_c")
    every = reduce(on, [rows.select("conv").distinct(), totals, numbers, illegal, found])
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    done = every.select("conv", _span(F.col("low"), F.col("high"), F.col("distinct")).alias("gaps"), *map(number, ("blank", "duplicate", "truncated", "illegal")), F.coalesce("best.cost", F.lit(0)).alias("cost"), F.coalesce("best.audit", F.lit("")).alias("audit"))
    return durable(done), turns


def _streamed(found: DataFrame, turns: DataFrame, digests: bool) -> DataFrame:
    """The repaired turns (conv, place, role, text) of long conversations, or the digest of each (conv, digest), from their sorted rows, each
    conversation's led by its audit."""
    kind = turns.schema["conv"].dataType.simpleString()
    arrow = to_arrow_type(turns.schema["conv"].dataType)
    lead = found.select("conv", F.lit(-1).cast("long").alias("at"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit("").alias("initial"))
    rows = lead.unionByName(turns.select("conv", "at", "role", "text", "initial")).repartition("conv").sortWithinPartitions("conv", "at")

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(conv, None, None) where a conversation begins, then (conv, role, text)."""
        conv, audit, at, place, ahead = None, "", 0, 0, 0
        due = lambda: "assistant" if (place - ahead) % 2 else "user"

        def inserted() -> Iterator[tuple]:
            nonlocal at, place
            while audit[at : at + 1] == "I":
                yield conv, due(), ""
                at, place = at + 1, place + 1

        for batch in batches:
            for now, role, text, initial, first in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text", "initial")), [x < 0 for x in batch.column("at").to_pylist()], strict=True):
                if first:
                    yield from inserted()
                    conv, audit, at, place, ahead = now, text, 0, 0, 0
                    yield conv, None, None
                    continue
                yield from inserted()
                edit, at = audit[at], at + 1
                if edit == "D":
                    continue
                if edit == "K" and initial == "s":
                    ahead = 1
                yield conv, role if edit == "K" else due(), text
                place += 1
        yield from inserted()

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, place = [], 0, 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), (arrow, pa.int64(), pa.string(), pa.string()), strict=True)], ["conv", "place", "role", "text"])
        for conv, role, text in repaired(batches):
            if role is None:
                place = 0
                continue
            held.append((conv, place, role, text))
            place, size = place + 1, size + len(text) + 64
            if size > TEXT_BYTES:
                yield pack()
                held, size = [], 0
        if held:
            yield pack()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = lambda conv, own: pa.RecordBatch.from_arrays([pa.array([conv], arrow), pa.array([own.hexdigest()])], ["conv", "digest"])
        conv, own, begun = None, None, False
        for now, role, text in repaired(batches):
            if role is None:
                if own:
                    yield pack(conv, own)
                conv, own, begun = now, hashlib.sha256(), False
                continue
            own.update(f"{chr(10) if begun else ''}{role}:{text}".encode())
            begun = True
        if own:
            yield pack(conv, own)

    if digests:
        return rows.mapInArrow(hashed, f"conv {kind}, digest string")
    return rows.mapInArrow(written, f"conv {kind}, place long, role string, text string")


def _parts(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` of conversations that fit one row, and those of longer ones if there are any."""
    sizes = rows.groupBy("conv").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    large = durable(sizes.where((F.col("n") > TURNS) | (F.col("bytes") > TEXT_BYTES)).select(F.col("conv").alias("_c")))
    if large.isEmpty():
        return rows, None
    own, large = F.col("conv").eqNullSafe(F.col("_c")), small(large)
    return rows.join(large, own, "left_anti"), rows.join(large, own, "left_semi")


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", there: str | None = None) -> DataFrame:
    """For each conversation its id, ``gaps`` (numbers that are missing between its least and greatest turn), the numbers of ``blank``, ``duplicate`` and
    ``truncated`` turns and of ``illegal`` neighbours, the ``cost`` and ``audit`` of its cheapest repair, and ``repaired_sha256``
    of its repaired turns (``role:text``, joined by line feeds). Turns whose column ``there`` names is false only make their conversation known."""
    rows, large = _parts(_prepared(turns, conv, turn, role, text, there))
    short = _short(rows)
    lines = F.transform(_rewritten(F.col("turns"), F.col("audit")), lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    out = short.withColumn("repaired_sha256", F.sha2(F.array_join(lines, "\n"), 256)).drop("turns")
    if large is not None:
        found, ordered = _long(large)
        digests = _streamed(found, ordered, True).withColumnRenamed("conv", "_c")
        out = out.unionByName(found.join(digests, F.col("conv").eqNullSafe(F.col("_c")), "left").drop("_c").withColumnRenamed("digest", "repaired_sha256"))
    return out.withColumnRenamed("conv", conv)


def repaired_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", there: str | None = None) -> DataFrame:
    """The repaired turns themselves: the conversation's id, ``place`` (from 0), role and text."""
    rows, large = _parts(_prepared(turns, conv, turn, role, text, there))
    out = _short(rows).select("conv", F.posexplode(_rewritten(F.col("turns"), F.col("audit"))).alias("place", "t")).select("conv", F.col("place").cast("long").alias("place"), "t.role", "t.text")
    if large is not None:
        out = out.unionByName(_streamed(*_long(large), False))
    return out.toDF(conv, "place", role, text)


def damaged(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``turns`` with faults put in by a checksum of conversation and turn: some dropped (``there`` is false), some emptied, some without the ends
    of sentences, some repeated, some given to the user."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(plain(conv), F.lit(":"), plain(turn)).cast("binary")) % 20
    rows = turns.select(F.col(conv), F.col(turn), plain(role).alias(role), plain(text).alias(text), kind.alias("_k"))
    spoilt = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.translate(text, ".!?", "")).when(F.col("_k") != 0, F.col(text))
    rows = rows.select(conv, turn, F.when(F.col("_k") == 4, "user").otherwise(F.col(role)).alias(role), spoilt.alias(text), (F.col("_k") != 0).alias("there"), F.explode(F.sequence(F.lit(0), F.when(F.col("_k") == 3, 1).otherwise(0))).alias("_copy"))
    return rows.drop("_copy")
