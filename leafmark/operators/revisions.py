"""Revisions of a text: maps of offsets as pieces that move, their composition, replay of records, blocks and ranges carried along.

A map is a table of pieces (key, lo, hi, shift): [lo, hi) of the text before
is found shift places on in the text after; what no piece has was consumed.
All is done in sorted passes over the rows of a key; nothing is paired.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmark.operators.spans import apply_edits


def pieces(texts: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """The map (key, lo, hi, shift) of texts (key, length) under disjoint edits (key, start, end, length: of what is put there)."""
    w = Window.partitionBy(key).orderBy("start", "end")
    ends = texts.select(key, F.col("length").cast("long").alias("start"), F.col("length").cast("long").alias("end"), F.lit(0).cast("long").alias("grows"))
    rows = edits.select(key, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), (F.col("length") - (F.col("end") - F.col("start"))).cast("long").alias("grows")).unionByName(ends)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    found = rows.select(key, F.coalesce(F.max("end").over(before), F.lit(0)).cast("long").alias("lo"), F.col("start").alias("hi"), F.coalesce(F.sum("grows").over(before), F.lit(0)).cast("long").alias("shift"))
    return found.where("lo < hi")


def merged(map_: DataFrame, key: str, order: str = "lo") -> DataFrame:
    """The same map with pieces that touch and move alike as one; order: a column that goes up with lo, by which the rows may lie sorted."""
    w = Window.partitionBy(key).orderBy(order)
    same = (F.lag("hi").over(w) == F.col("lo")) & (F.lag("shift").over(w) == F.col("shift"))
    marked = map_.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("shift").alias("shift")).drop("_run")


def _ends(map_: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """(key, at, name): where each piece begins, with its end and value, and where it ends, with null; the pieces are computed once."""
    own = F.struct(F.col("hi"), F.col(value))
    begin, stop = F.struct(F.col("lo").alias("at"), own.alias(name)), F.struct(F.col("hi").alias("at"), F.when(F.lit(False), own).alias(name))
    return map_.select(key, F.explode(F.array(begin, stop)).alias("_e")).select(key, "_e.at", f"_e.{name}")


def _stretches(a: DataFrame, b: DataFrame, key: str, names: tuple[str, str]) -> DataFrame:
    """(key, at, to, names): the stretches between the ends in a and b (_ends) that a piece of each holds, with these pieces; sorted by key and at.

    Of several ends at one place only the last has the next place after it, and it has seen all of them.
    """
    w = Window.partitionBy(key).orderBy("at")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = a.unionByName(b, allowMissingColumns=True)
    cut = rows.select(key, "at", F.lead("at").over(w).alias("to"), *[F.last(n, ignorenulls=True).over(so_far).alias(n) for n in names])
    return cut.where((F.col("at") < F.col("to")) & (F.col("at") < F.col(f"{names[0]}.hi")) & (F.col("at") < F.col(f"{names[1]}.hi")))


def compose(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """The map of two revisions one after the other.

    The ends of the first map's pieces, where it puts them, and of the
    second's cut a text into stretches; the piece of each map that began last
    holds a stretch or ends before it.
    """
    a = first.select(key, (F.col("lo") + F.col("shift")).alias("lo"), (F.col("hi") + F.col("shift")).alias("hi"), "shift")
    held = _stretches(_ends(a, key, "a", "shift"), _ends(second, key, "b", "shift"), key, ("a", "b"))
    return merged(held.select(key, "at", (F.col("at") - F.col("a.shift")).alias("lo"), (F.col("to") - F.col("a.shift")).alias("hi"), (F.col("a.shift") + F.col("b.shift")).alias("shift")), key, "at")


def mapped(points: DataFrame, map_: DataFrame, key: str, at: str = "at") -> DataFrame:
    """points with `mapped`: where the map puts the character at each place; null where it was consumed."""
    names = points.columns
    rows = points.withColumns({"_at": F.col(at).cast("long"), "_kind": F.lit(1)})
    marks = map_.select(key, F.col("lo").alias("_at"), F.lit(0).alias("_kind"), F.struct("hi", "shift").alias("_p"))
    w = Window.partitionBy(key).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(marks, allowMissingColumns=True).withColumn("_p", F.last("_p", ignorenulls=True).over(w)).where("_kind = 1")
    return both.select(*names, F.when(F.col("_at") < F.col("_p.hi"), F.col("_at") + F.col("_p.shift")).alias("mapped"))


def replay(texts: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """(key, status): whether the recorded edits (start, end, length, in their order) turn each text (key, before, after) into what was saved.

    Each edit's new text is cut from what was saved, where the edits before
    put it; applied to the text before, they must reproduce it: reproduced, or
    differs, length (texts and records don't agree in length), overlap (edits
    aren't disjoint or leave the text).
    """
    w = Window.partitionBy(key).orderBy("start", "end", "ord")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    grows = (F.col("length") - (F.col("end") - F.col("start"))).cast("long")
    placed = records.withColumn("_delta", F.coalesce(F.sum(grows).over(before), F.lit(0))).withColumn("_over", F.coalesce(F.max("end").over(before), F.lit(0)) > F.col("start"))
    joined = placed.join(texts.select(key, "after", F.char_length("before").alias("_n")), key)
    edits = joined.withColumn("insert", F.expr("substring(after, int(start + _delta + 1), int(length))"))
    faults = edits.groupBy(key).agg(F.max((F.col("_over") | (F.col("start") < 0) | (F.col("end") < F.col("start")) | (F.col("end") > F.col("_n"))).cast("int")).alias("_bad"), F.sum(grows).alias("_grows"))
    done = apply_edits(texts.select(key, F.col("before").alias("text")), edits.where("not _over").select(key, F.col("start").cast("int"), F.col("end").cast("int"), "insert"), key)
    both = texts.join(done, key).join(faults, key, "left")
    length = F.char_length("before") + F.coalesce("_grows", F.lit(0)) != F.char_length("after")
    status = F.when(F.coalesce("_bad", F.lit(0)) == 1, "overlap").when(length, "length").when(F.col("edited") == F.col("after"), "reproduced").otherwise("differs")
    return both.select(key, status.alias("status"))


def rebind(blocks: DataFrame, map_: DataFrame, key: str, begin: int, end: int) -> DataFrame:
    """blocks with status: whether each is where its revision says, followed by its own marks.

    blocks: (key, block, start, stop) in the text before, (new_start,
    new_stop) as recorded after, (made_start, made_stop) where an edit made
    it.  A block is followed by the first character of its begin mark (of
    `begin` characters) and of its end mark (of `end`), neither of which an
    edit may consume; one that is new by where its edit put it.  Status: kept,
    created, lost (a mark was consumed), moved (not where it was recorded),
    appeared (new without an edit that made it), conflict (old and made).
    """
    old, made = F.col("start").isNotNull(), F.col("made_start").isNotNull()
    ends = (F.col("start"), F.col("start") + begin - 1, F.col("stop") - end, F.col("stop") - 1)
    points = blocks.where(old).select(key, "block", F.explode(F.array(*[F.struct(F.lit(k).alias("e"), at.cast("long").alias("at")) for k, at in enumerate(ends)])).alias("p")).select(key, "block", "p.e", "p.at")
    found = mapped(points, map_, key).groupBy(key, "block").agg(*[F.max(F.when(F.col("e") == k, F.col("mapped"))).alias(f"_{k}") for k in range(4)])
    joined = blocks.join(found, [key, "block"], "left")
    whole = (F.col("_1") - F.col("_0") == begin - 1) & (F.col("_3") - F.col("_2") == end - 1)
    there = lambda a, b: (a == F.col("new_start")) & (b == F.col("new_stop"))
    status = (
        F.when(old & made, "conflict")
        .when(made, F.when(there(F.col("made_start"), F.col("made_stop")), "created").otherwise("moved"))
        .when(~old, "appeared")
        .when(~F.coalesce(whole, F.lit(False)), "lost")
        .when(F.coalesce(there(F.col("_0"), F.col("_3") + 1), F.lit(False)), "kept")
        .otherwise("moved")
    )
    return joined.select(*blocks.columns, status.alias("status"))


def project_ranges(ranges: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """ranges with new_start, new_end and status after several disjoint edits (start, end, length) of their text.

    ranges: (key, id, start, end, start_affinity, end_affinity), start < end.
    Text put at an edge belongs to the range with affinity inside, not with
    outside; with reject it is refused.  Status: kept, gone (nothing of it is
    left), crossed (a replacement crosses an edge), edge (text at an edge that
    rejects it).  Along a text, what ended before a place and what is open
    there are running sums.
    """
    grows = (F.col("length") - (F.col("end") - F.col("start"))).cast("long")
    insertion = F.col("start") == F.col("end")
    event = lambda d, at, kind, g, o, n: d.select(key, F.col(at).cast("long").alias("_at"), F.lit(kind).alias("_kind"), g.alias("_g"), F.lit(o).alias("_o"), n.cast("int").alias("_n"))
    none = F.lit(0).cast("long")
    rows = event(edits.where(~insertion), "end", 0, grows, -1, F.lit(0)).unionAll(event(edits.where(~insertion), "start", 4, none, 1, F.lit(0))).unionAll(event(edits.where(insertion), "start", 2, grows, 0, F.col("length") > 0))
    asks = ranges.select(key, "id", F.explode(F.array(*[F.struct(F.lit(e).alias("end_of"), F.col(c).cast("long").alias("at"), F.lit(k).alias("kind")) for e, c in enumerate(("start", "end")) for k in (1, 3)])).alias("q"))
    asked = asks.select(key, "id", F.col("q.end_of").alias("_end_of"), F.col("q.at").alias("_at"), F.col("q.kind").alias("_kind"), none.alias("_g"), F.lit(0).alias("_o"), F.lit(0).alias("_n"))
    w = Window.partitionBy(key).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    summed = asked.unionByName(rows, allowMissingColumns=True).withColumns({c: F.sum(c).over(w) for c in ("_g", "_o", "_n")}).where("_end_of is not null")
    value = lambda c, e, k: F.max(F.when((F.col("_end_of") == e) & (F.col("_kind") == k), F.col(c)))
    per = summed.groupBy(key, "id").agg(*[value(c, e, k).alias(f"{c}{e}{k}") for c in ("_g", "_o", "_n") for e in (0, 1) for k in (1, 3)])
    both = ranges.join(per, [key, "id"])
    inside = lambda c: F.col(c) == "inside"
    lo = F.col("start") + F.when(inside("start_affinity"), F.col("_g01")).otherwise(F.col("_g03"))
    hi = F.col("end") + F.when(inside("end_affinity"), F.col("_g13")).otherwise(F.col("_g11"))
    crossed = (F.col("_o01") > 0) | (F.col("_o11") > 0)
    edge = ((F.col("start_affinity") == "reject") & (F.col("_n03") > F.col("_n01"))) | ((F.col("end_affinity") == "reject") & (F.col("_n13") > F.col("_n11")))
    status = F.when(crossed, "crossed").when(edge, "edge").when(lo >= hi, "gone").otherwise("kept")
    kept = status == "kept"
    return both.select(*ranges.columns, F.when(kept, lo).alias("new_start"), F.when(kept, hi).alias("new_end"), status.alias("status"))


def restyle(spans: DataFrame, edits: DataFrame, key: str, typing: str) -> DataFrame:
    """(key, start, end, style, refused): the style spans of texts after several disjoint edits.

    spans (key, start, end, style) partition each text; edits (key, start,
    end, length, style) put text of one style there.  Without a style new text
    takes that of what it replaces, or of what it stands between; where these
    differ the whole text is refused: one row with the flag and no span.  A
    text that was empty takes `typing`.  Spans that touch and are alike are one.
    """
    whole = _alike(spans.select(key, F.col("start").cast("long").alias("lo"), F.col("end").cast("long").alias("hi"), "style"), key)
    lengths = spans.groupBy(key).agg(F.max("end").cast("long").alias("length"))
    put = edits.select(key, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("length").cast("long").alias("n"), F.col("style").alias("given"))
    put = put.join(lengths, key, "left").withColumn("length", F.coalesce("length", F.lit(0).cast("long")))
    insertion = F.col("start") == F.col("end")
    # the span of the character before an insertion, or of the first that is replaced
    asked = put.withColumns({"_at": F.when(insertion, F.greatest(F.col("start") - 1, F.lit(0))).otherwise(F.col("start")), "_kind": F.lit(1)})
    marks = whole.select(key, F.col("lo").alias("_at"), F.lit(0).alias("_kind"), F.struct("hi", "style").alias("_s"))
    w = Window.partitionBy(key).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = asked.unionByName(marks, allowMissingColumns=True).withColumn("_s", F.last("_s", ignorenulls=True).over(w)).where("_kind = 1")
    one = F.when(insertion, (F.col("start") == 0) | (F.col("_s.hi") > F.col("start")) | (F.col("start") >= F.col("length"))).otherwise(F.col("_s.hi") >= F.col("end"))
    own = F.coalesce("given", F.when(F.col("_s").isNull(), F.lit(typing)).when(one, F.col("_s.style")))
    order = Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    new = found.withColumn("_style", own).withColumn("lo", F.col("start") + F.coalesce(F.sum(F.col("n") - (F.col("end") - F.col("start"))).over(order), F.lit(0)))
    new = new.select(key, "lo", (F.col("lo") + F.col("n")).alias("hi"), F.col("_style").alias("style")).where("lo < hi")
    # what is kept of each span: pieces and spans cut the text before
    kept = pieces(lengths, put.select(key, "start", "end", F.col("n").alias("length")), key)
    held = _stretches(_ends(whole, key, "s", "style"), _ends(kept, key, "p", "shift"), key, ("s", "p"))
    moved = held.select(key, (F.col("at") + F.col("p.shift")).alias("lo"), (F.col("to") + F.col("p.shift")).alias("hi"), F.col("s.style").alias("style"))
    # a refused text keeps its first row
    all_ = moved.withColumn("bad", F.lit(False)).unionByName(new.withColumn("bad", F.col("style").isNull()))
    all_ = all_.withColumns({"_k": F.row_number().over(Window.partitionBy(key).orderBy("lo")), "bad": F.max("bad").over(Window.partitionBy(key))}).where("not bad or _k = 1")
    ok = lambda c: F.when(~F.col("bad"), F.col(c))
    return _alike(all_.drop("_k"), key).select(key, ok("lo").alias("start"), ok("hi").alias("end"), ok("style").alias("style"), F.col("bad").alias("refused"))


def _alike(spans: DataFrame, key: str) -> DataFrame:
    """Spans (key, lo, hi, style; more) that partition a text, those that follow each other in one style as one: the first, up to where the next begins."""
    w = Window.partitionBy(key).orderBy("lo")
    first = F.row_number().over(w) == 1
    marked = spans.withColumns({"_new": first | ~F.lag("style").over(w).eqNullSafe(F.col("style")), "_end": F.max("hi").over(Window.partitionBy(key))}).where("_new")
    return marked.withColumn("hi", F.coalesce(F.lead("lo").over(w), F.col("_end"))).drop("_new", "_end")
