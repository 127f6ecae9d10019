"""Topic records and their blocks as Spark rows (S19-S22, O1-O16, J1, J3, J5, J9, D3, D4, FL2).

An archive's topic file comes in segments, slices of some hundred blocks, and all that follows is joins, windows and aggregates
over rows; no task holds more than a segment, a record or a batch.

* *Blocks to stream* (S19, S20): each segment is decompressed on its own and written, with the block behind it, so that a header
  never lies across two segments.
* *Record chain* (S21): records name their successor by position only. Every segment is walked from a guess, the first record that one of its block headers
  names; a walk is a node ``(file, entry)``, with its records, and its exit is the entry of the next. List ranking by pointer doubling joins the nodes from
  position 0 on: after ``t`` joins the first ``2^t`` are ranked. Exits that no guess foresaw are walked and ranked again, so a wrong guess costs a round and
  changes no row. A chain that returns is an error at the record where it does.
* *Phrases* (D3, D4, J5): a file's packed records meet its phrase table in parts of some thousand; every number of a phrase must be in the table. A row a token would be a hundred times the text.
* *Commands* (O1-O16): a record's commands are event rows. The segment of text is a running count of the events that take one, the style is carried from the
  last font event, fonts and context names come from one join, runs of plain text are merged where nothing parts them.

Keys that many rows share (an archive's font 0) are dealt over salts.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from docspark.functions.text import context_name, split_style, unresolved_name
from docspark.operators.relational import dealt_join, last_value, unbroadcast
from docspark.sources import codecs, opcodes
from docspark.sources import container as c
from docspark.storage import Workspace

_RECORD = "ord int, at bigint, kind int, link1 binary, link2 binary, length2 bigint, next bigint, delta int, size bigint, length1 bigint, open boolean"
_NODE = f"file string, seg int, entry bigint, exit bigint, n int, before_31 boolean, hall boolean, phrases int, records array<struct<{_RECORD.replace(' ', ':').replace(',:', ',')}>>"
_LISTED = pa.list_(pa.struct([
    ("ord", pa.int32()), ("at", pa.int64()), ("kind", pa.int32()), ("link1", pa.binary()), ("link2", pa.binary()), ("length2", pa.int64()), ("next", pa.int64()), ("delta", pa.int32()),
    ("size", pa.int64()), ("length1", pa.int64()), ("open", pa.bool_()),
]))


# ---- S19, S20


def _streamed(segments: DataFrame) -> DataFrame:
    """Every segment decompressed: its own bytes, those of the block behind them, and the records its block headers name."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                own, over, data, named = 0, 0, [], []
                for i, (_, first, _, body) in enumerate(c.blocks(row["raw"], row["block_size"], row["lz77"])):
                    data.append(body.ljust(row["decompress_size"], b"\0"))
                    if i < row["own_blocks"]:
                        own += len(data[-1])
                        over += len(data[-1]) - row["decompress_size"]
                        named.append(first - 12)
                made = {"file": row["file"], "seg": row["seg"], "base": row["seg"] * row["own_blocks"] * row["decompress_size"], "own": own, "over": over, "named": named, "data": b"".join(data)}
                made |= {"more": len(data) > row["own_blocks"]} | {k: row[k] for k in ("before_31", "hall", "phrases")}
                yield pa.RecordBatch.from_pylist([made], schema)

    out = "file string, seg int, base bigint, own bigint, over bigint, more boolean, before_31 boolean, hall boolean, phrases int, named array<bigint>, data binary"
    schema = pa.schema([
        ("file", pa.string()), ("seg", pa.int32()), ("base", pa.int64()), ("own", pa.int64()), ("over", pa.int64()), ("more", pa.bool_()), ("before_31", pa.bool_()), ("hall", pa.bool_()), ("phrases", pa.int32()),
        ("named", pa.list_(pa.int64())), ("data", pa.binary()),
    ])
    return segments.mapInArrow(run, out)


def _placed(stream: DataFrame) -> DataFrame:
    """Segments with ``start``, their place in the stream: blocks that unpack to more than their size move what follows."""
    moved = stream.where("over > 0").select("file", "seg", "over")
    if not moved.limit(1).count():
        return stream.withColumn("start", F.col("base"))
    every = stream.select("file", "seg", "over").join(moved.select("file").distinct(), "file", "left_semi")
    before = F.sum("over").over(Window.partitionBy("file").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1))
    return stream.join(every.select("file", "seg", before.alias("before")), ["file", "seg"], "left").withColumn("start", F.col("base") + F.coalesce("before", F.lit(0))).drop("before")


# ---- S21


def _walks(placed: DataFrame, entries: Column) -> DataFrame:
    """A node for each of a segment's ``entries`` that lies in it."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                for entry in dict.fromkeys(row["entries"]):
                    if row["start"] <= entry < row["start"] + row["own"]:
                        yield node(row, entry)

    def node(row, entry):
        found, out = c.walk(row["data"], row["start"], row["own"], entry, row["before_31"])
        records = []
        for i, (at, size, length2, following, length1, kind) in enumerate(found):
            o, end = at - row["start"], at - row["start"] + size
            cut = o + max(length1, 21)
            link1 = row["data"][o + 21 : min(cut, end)]
            delta = opcodes.offset_delta(link1) if kind in (c.TEXT, c.TABLE) else 0
            records.append({
                "ord": i, "at": at, "kind": kind, "link1": link1, "link2": row["data"][min(cut, end) : end], "length2": length2, "next": following, "delta": delta,
                "size": size, "length1": length1, "open": row["more"] and end > len(row["data"]),
            })
        made = {"file": row["file"], "seg": row["seg"], "entry": entry, "exit": out, "n": len(records), "records": records}
        return pa.RecordBatch.from_pylist([made | {k: row[k] for k in ("before_31", "hall", "phrases")}], schema)

    schema = pa.schema([
        ("file", pa.string()), ("seg", pa.int32()), ("entry", pa.int64()), ("exit", pa.int64()), ("n", pa.int32()), ("before_31", pa.bool_()), ("hall", pa.bool_()), ("phrases", pa.int32()), ("records", _LISTED),
    ])
    held = placed.select("file", "seg", "start", "own", "more", "before_31", "hall", "phrases", "data", entries.alias("entries"))
    return held.mapInArrow(run, _NODE)


def ranked(nodes: DataFrame, work: Workspace) -> DataFrame:
    """``(file, entry, rank)``: how many records come before each entry that the chain from 0 reaches, its last exits included.

    ``nodes(file, entry, exit, n)`` has a row an entry. Pointer doubling: ``jumps`` leads from an entry to the one ``2^t`` further on.
    """
    reached = nodes.where("entry = 0").select("file", "entry", F.lit(0).cast("long").alias("rank"))
    jumps = nodes.where("exit is not null").select("file", "entry", F.col("exit").alias("to"), F.col("n").cast("long").alias("n"))
    most = jumps.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    spread = 1
    while spread <= most:
        further = reached.join(jumps, ["file", "entry"]).select("file", F.col("to").alias("entry"), (F.col("rank") + F.col("n")).alias("rank"))
        reached = work.table(reached.unionByName(further).groupBy("file", "entry").agg(F.min("rank").alias("rank")), "reached")
        spread *= 2
        if spread <= most:
            on = jumps.select("file", F.col("entry").alias("to"), F.col("to").alias("beyond"), F.col("n").alias("more"))
            jumps = work.table(jumps.join(on, ["file", "to"]).select("file", "entry", F.col("beyond").alias("to"), (F.col("n") + F.col("more")).alias("n")), "jumps")
    return reached


def _chained(placed: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """The nodes with the rank of those the chain reaches, and its faults ``(file, rec_no, message)``."""
    guess = F.filter("named", lambda x: (x >= F.col("start")) & (x < F.col("start") + F.col("own")))
    start = F.when(F.col("seg") == 0, F.array(F.lit(0).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    nodes = work.table(_walks(placed, F.concat(start, F.slice(guess, 1, 1))), "nodes")
    while True:
        narrow = nodes.select("file", "seg", "entry", "exit", "n")
        rank = ranked(narrow, work)
        missing = rank.join(narrow.select("file", "entry"), ["file", "entry"], "left_anti").select("file", "entry")
        place = placed.select("file", "seg", F.col("start").alias("low"), (F.col("start") + F.col("own")).alias("high"))
        missing = missing.join(place, "file").where("low <= entry and entry < high").groupBy("file", "seg").agg(F.collect_set("entry").alias("entries"))
        missing = work.table(missing, "missing")
        if not missing.limit(1).count():
            break
        nodes = work.table(nodes.unionByName(_walks(placed.join(missing, ["file", "seg"]), F.col("entries"))), "nodes")
    on = narrow.join(rank, ["file", "entry"])
    back = on.select("file", F.col("exit").alias("entry"), (F.col("rank") + F.col("n")).alias("rec_no"), "rank").join(rank.withColumnRenamed("rank", "first"), ["file", "entry"]).where("first <= rank")
    faults = back.select("file", "rec_no", F.concat(F.lit("record chain returns to "), F.col("entry").cast("string")).alias("message"))
    # walks of one segment may meet behind their entries
    twice = work.table(on.groupBy("file", "seg").count().where("count > 1").select("file", "seg"), "twice")
    met = nodes.select("file", "seg", "entry", F.explode("records").alias("r")).join(twice, ["file", "seg"], "left_semi").join(rank, ["file", "entry"])
    again = Window.partitionBy("file", "at").orderBy("rec_no")
    met = met.select("file", F.col("r.at").alias("at"), (F.col("rank") + F.col("r.ord")).alias("rec_no")).withColumn("time", F.row_number().over(again)).where("time = 2")
    faults = faults.unionByName(met.select("file", "rec_no", F.concat(F.lit("record chain returns to "), F.col("at").cast("string")).alias("message")))
    return nodes.join(rank, ["file", "entry"]), faults


def _completed(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """Records whose bytes go on in further segments, from the slices of all of these."""
    spans = placed.select("file", "start", "own", "data")
    stop = F.col("at") + F.col("size")
    parts = rows.select("file", "rec_no", "at", "size").join(spans, "file").where((F.col("start") < stop) & (F.col("start") + F.col("own") > F.col("at")))
    slices = parts.select("file", "rec_no", "start", F.expr("substring(data, cast(greatest(at, start) - start + 1 as int), cast(least(at + size, start + own) - greatest(at, start) as int))").alias("piece"))
    whole = slices.groupBy("file", "rec_no").agg(_joined("start", "piece").alias("bytes"))
    cut = F.greatest("length1", F.lit(21).cast("long"))
    made = rows.join(whole, ["file", "rec_no"])
    made = made.withColumns({"link1": F.substring("bytes", F.lit(22), (cut - 21).cast("int")), "link2": F.substring("bytes", (cut + 1).cast("int"), F.greatest(F.lit(0).cast("long"), F.col("size") - cut).cast("int"))})

    def deltas(batches):
        for batch in batches:
            kinds, links = batch.column("kind").to_pylist(), batch.column("link1").to_pylist()
            found = [opcodes.offset_delta(x) if k in (c.TEXT, c.TABLE) else 0 for k, x in zip(kinds, links, strict=True)]
            at = batch.schema.get_field_index("delta")
            yield batch.set_column(at, "delta", pa.array(found, pa.int32()))

    made = made.select(rows.columns)
    return made.mapInArrow(deltas, made.schema)


def _joined(order: str, piece: str) -> Column:
    """Binary pieces behind each other in order; bytes are one character each on the way."""
    listed = F.sort_array(F.collect_list(F.struct(order, F.decode(piece, "ISO-8859-1").alias("said"))))
    return F.encode(F.array_join(F.transform(listed, lambda x: x["said"]), ""), "ISO-8859-1")


# ---- D3, D4, J5


#: Records of a file whose packed texts meet its phrase table in one group.
_PART = 1024


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows``: what Python makes of them is many times their size."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _unpacked(rows: pa.RecordBatch | pa.Table, tables: Iterable[Mapping[int, bytes]]) -> list[pa.Array]:
    """``link2`` with phrases in place of their numbers, and ``message``."""
    columns = [rows.column(x).to_pylist() for x in ("link2", "hall", "phrases")]
    made = [codecs.expand(data, hall, table, count) for data, hall, count, table in zip(*columns, tables)]  # noqa: B905  tables may go on
    return [pa.array([x[0] for x in made], pa.binary()), pa.array([x[1] for x in made], pa.string())]


def expanded(rows: DataFrame, phrases: DataFrame) -> DataFrame:
    """``rows(file, rec_no, link2, hall, phrases, ...)`` with the tokens of ``link2`` replaced by ``phrases(file, idx, bytes)``, and ``message``.

    ``message`` names a number that the table lacks, or a token that is cut. A file's records meet its table in parts of some thousand.
    """
    part = "part"
    while part in rows.columns:
        part += "_"
    kept = rows.columns
    kind = StructType([*rows.schema.fields, StructField("message", StringType())])
    schema = to_arrow_schema(kind)

    def run(key, left, right):
        table = dict(zip(right.column("idx").to_pylist(), right.column("bytes").to_pylist(), strict=True))
        own = left.select(kept)
        link2, message = _unpacked(own, itertools.repeat(table))
        columns = [link2 if name == "link2" else own.column(name) for name in kept]
        return pa.Table.from_arrays([*columns, message], names=schema.names).cast(schema)

    held = rows.withColumn(part, F.floor(F.col("rec_no") / _PART).cast("long"))
    spread = held.select(F.col("file").alias("of"), F.col(part).alias("at")).distinct().join(phrases.select(F.col("file").alias("of"), "idx", "bytes"), "of")
    return held.groupBy("file", part).cogroup(spread.groupBy("of", "at")).applyInArrow(run, kind)


def expanded_by_own(rows: DataFrame) -> DataFrame:
    """As :func:`expanded`, where each of ``rows`` has a phrase table of its own beside it, the internal file ``table``."""
    kind = StructType([*[f for f in rows.schema.fields if f.name != "table"], StructField("message", StringType())])
    schema = to_arrow_schema(kind)

    def run(batches):
        for batch in sliced(batches):
            link2, message = _unpacked(batch, (dict(enumerate(codecs.phrases_inline(x))) for x in batch.column("table").to_pylist()))
            columns = [link2 if name == "link2" else batch.column(name) for name in schema.names[:-1]]
            yield pa.RecordBatch.from_arrays([*columns, message], names=schema.names)

    return rows.mapInArrow(run, kind)


def records(segments: DataFrame, phrases: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """The record table of ``segments``, up to each file's first fault, and these faults ``(file, rec_no, message)``.

    What lies between, several times the text, is deleted before blocks are made of the records.
    """
    between = Workspace(work.spark, "chains")
    # an archive's segments come from one task; from here on they are dealt over all
    n = segments.count()
    dealt = segments.repartition(max(1, min(n, max(4 * work.spark.sparkContext.defaultParallelism, n // 16))), "file", "seg")
    placed = _placed(between.table(_streamed(dealt), "stream"))
    nodes, faults = _chained(placed, between)
    rows = nodes.select("file", "before_31", "hall", "phrases", "rank", F.explode("records").alias("r")).select("file", (F.col("rank") + F.col("r.ord")).alias("rec_no"), "before_31", "hall", "phrases", "r.*")
    rows = between.table(rows, "chain")
    open_ = rows.where("open")
    if open_.limit(1).count():
        rows = rows.where("not open").unionByName(_completed(open_, placed))
    packs = F.expr("coalesce(phrases > 0 and length2 > octet_length(link2), false)")
    packed = rows.where(packs)
    if packed.limit(1).count():
        whole = between.table(expanded(packed, phrases.where("_error is null")), "expanded")
        faults = faults.unionByName(whole.where("message is not null").select("file", "rec_no", "message"))
        rows = rows.where(~packs).unionByName(whole.drop("message"))
    first = work.table(faults.groupBy("file").agg(F.min(F.struct("rec_no", "message")).alias("f")).select("file", "f.*"), "faults")
    if first.limit(1).count():
        rows = rows.join(first.select("file", F.col("rec_no").alias("stop")), "file", "left").where("stop is null or rec_no < stop")
    title = F.when(F.col("kind") == c.TOPIC, F.nullif(F.substring_index(_text("link2"), "\0", 1), F.lit("")))
    made = rows.select(
        "file", F.col("rec_no").cast("int").alias("rec_no"), F.col("kind").alias("record_type"), F.col("link1").alias("link_data1"), F.col("link2").alias("link_data2"), F.col("length2").alias("data_len2"),
        F.col("next").alias("next_block"), F.col("at").alias("stream_offset"), "delta", "before_31", title.alias("title"),
    )
    made = work.table(made, "records")
    between.close()
    return made, first


def _text(name: str) -> Column:
    """Bytes as UTF-8, broken ones replaced."""
    return F.make_valid_utf8(F.col(name).cast("string"))


# ---- O1-O16, J1, J3, J9


def _events(rows: DataFrame) -> DataFrame:
    """``(file, rec_no, ev_no, code, number)``: the commands of every text and table record."""

    def run(batches):
        for batch in batches:
            out = {"file": [], "rec_no": [], "ev_no": [], "code": [], "number": []}
            for row in batch.to_pylist():
                for i, (code, number) in enumerate(opcodes.commands(row["record_type"], row["link_data1"])):
                    for name, value in zip(out, (row["file"], row["rec_no"], i, code, number), strict=True):
                        out[name].append(value)
            types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], list(out))

    chosen = rows.where(F.col("record_type").isin(c.TEXT, c.TABLE)).select("file", "rec_no", "record_type", "link_data1")
    return chosen.mapInArrow(run, "file string, rec_no int, ev_no int, code int, number bigint")


#: Runs as the block table has them.
RUNS = "array<struct<kind:string,text:string,bold:boolean,italic:boolean,target:string,link_kind:string>>"


def blocks(rows: DataFrame, fonts: DataFrame, context: DataFrame) -> DataFrame:
    """``(file, rec_no, block_no, kind, inlines, image, placement)``: paragraphs and pictures of the records ``rows``."""
    jumps, popups = opcodes.JUMPS, opcodes.POPUPS
    starts = F.col("code").isin(*jumps, *popups)
    event = _events(rows)
    # What a font number or a context hash stands for
    names = last_value(context.where("_error is null"), ["file", "hash"], "topic_offset", ["ord"]).select("file", F.lit("name").alias("what"), F.col("hash").alias("number"), F.lit(None).cast("int").alias("style"), context_name(F.col("hash")).alias("name"))
    styles = fonts.where("_error is null").select("file", F.lit("font").alias("what"), F.col("idx").cast("long").alias("number"), F.col("attributes").alias("style"), F.lit(None).cast("string").alias("name"))
    event = event.withColumn("what", F.when(F.col("code") == opcodes.FONT, "font").when(starts, "name"))
    event = dealt_join(event, styles.unionByName(names), ["file", "what", "number"], ["rec_no", "ev_no"], "left")
    target = F.when(starts, F.struct(F.coalesce("name", unresolved_name(F.col("number"))).alias("target"), F.when(F.col("code").isin(*jumps), "jump").otherwise("popup").alias("link_kind")))
    event = event.withColumns({"target": target, "style": F.when(F.col("code") == opcodes.FONT, F.coalesce("style", F.lit(0)))})
    # The style and the link in force, and how many segments were taken before
    before = Window.partitionBy("file", "rec_no").orderBy("ev_no").rowsBetween(Window.unboundedPreceding, -1)
    opened = F.last(F.when(starts, True).when(F.col("code") == opcodes.LINK_END, False), ignorenulls=True).over(before)
    event = event.withColumns({"linked": F.coalesce(opened, F.lit(False)), "link": F.last("target", ignorenulls=True).over(before), "now": F.coalesce(F.last("style", ignorenulls=True).over(before), F.lit(0))})
    ends = (F.col("code") == opcodes.LINK_END) & F.col("linked")
    takes = F.col("code").isin(*opcodes.TAKE) | starts | ends
    event = event.withColumn("seg_no", F.coalesce(F.sum(takes.cast("int")).over(before), F.lit(0).cast("long")))
    # Its text, empty where there are no more
    said = rows.where(F.col("record_type").isin(c.TEXT, c.TABLE)).select("file", "rec_no", F.posexplode(F.split(_text("link_data2"), "\0", -1)).alias("seg_no", "said"))
    event = event.join(unbroadcast(said.withColumn("seg_no", F.col("seg_no").cast("long"))), ["file", "rec_no", "seg_no"], "left").withColumn("said", F.coalesce("said", F.lit("")))
    item = lambda kind, text=None, link=None: F.struct(F.lit(kind).alias("kind"), (F.lit(None).cast("string") if text is None else text).alias("text"), (F.lit(None).cast("string") if link is None else link["target"]).alias("target"), (F.lit(None).cast("string") if link is None else link["link_kind"]).alias("link_kind"))
    code = F.col("code")
    says = code.isin(opcodes.FONT, *opcodes.SAY)
    styled = says & (F.col("now").bitwiseAND(3) != 0)
    cut = split_style(F.col("said"))
    items = F.array(
        F.when(styled, item("text", cut["lead"])).when(says, item("text", F.col("said"))), F.when(styled, item("styled", cut["core"])), F.when(styled, item("text", cut["tail"])),
        F.when(code == opcodes.BLANK, item("text", F.lit(" "))).when(code == opcodes.TAB, item("text", F.lit("\t"))),
        F.when(ends, item("link", F.when(F.col("said") == "", F.col("link")["target"]).otherwise(F.col("said")), F.col("link"))),
        F.when(code.isin(opcodes.PARAGRAPH, opcodes.CELL), item("break")),
        F.when(code.isin(*opcodes.PICTURES) & F.col("number").isNotNull(), item("image", F.concat(F.lit("|bm"), F.col("number").cast("string")))),
    )
    items = F.filter(items, lambda x: x.isNotNull() & (x["kind"].isin("break", "image", "link") | (x["text"] != "")))
    piece = event.select("file", "rec_no", "ev_no", "now", "code", F.posexplode(items).alias("sub", "i")).select("file", "rec_no", F.struct("ev_no", "sub").alias("at"), "now", "code", "i.*")
    # What a paragraph is, and which plain runs touch each other
    line = Window.partitionBy("file", "rec_no").orderBy("at")
    parts = F.col("kind").isin("break", "image")
    piece = piece.withColumn("part", F.count_if(parts).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    plain = F.col("kind") == "text"
    joins = plain & F.coalesce(F.lag(plain).over(line), F.lit(False))
    piece = piece.withColumn("run", F.count_if(~joins).over(line.rowsBetween(Window.unboundedPreceding, 0))).where("kind <> 'break'")
    listed = F.sort_array(F.collect_list(F.struct("at", "text")))
    merged = piece.groupBy("file", "rec_no", "part", "run").agg(F.first("kind").alias("kind"), F.first("now").alias("now"), F.first("code").alias("code"), F.array_join(F.transform(listed, lambda x: x["text"]), "").alias("text"), F.first("target").alias("target"), F.first("link_kind").alias("link_kind"))
    flag = lambda n: (F.col("kind") == "styled") & (F.col("now").bitwiseAND(n) != 0)
    run = F.struct(F.when(F.col("kind") == "link", "link").otherwise("text").alias("kind"), "text", flag(1).alias("bold"), flag(2).alias("italic"), "target", "link_kind")
    shown = F.col("kind") == "image"
    block = merged.groupBy("file", "rec_no", "part", (~shown).alias("runs")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("run", run.alias("r")))), lambda x: x["r"]).alias("inlines"), F.first("text").alias("image"), F.first("code").alias("code"),
    )
    number = F.row_number().over(Window.partitionBy("file", "rec_no").orderBy("part", "runs")) - 1
    place = F.when(F.col("code") == opcodes.PICTURES[0], "inline").when(F.col("code") == opcodes.PICTURES[1], "left").otherwise("right")
    return block.select(
        "file", "rec_no", number.alias("block_no"), F.when(F.col("runs"), "paragraph").otherwise("image").alias("kind"), F.when(F.col("runs"), F.col("inlines")).otherwise(F.array()).cast(RUNS).alias("inlines"),
        F.when(~F.col("runs"), F.col("image")).alias("image"), F.when(~F.col("runs"), place).alias("placement"),
    )

