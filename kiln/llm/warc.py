"""WARC archives: writing pages as records, reading them by verified chains.

Writing: a payload that repeats is stored once, as a response record; the
other pages with it become revisit records.  Spark's text writer puts the
records out, separated by the blank lines that end a WARC record.

Reading: Spark's text source splits the archives at record magics, so every
task of every byte range emits *candidates*: the offset of a magic and, from
the header's length, the offset of the successor.  A payload may hold magics,
even whole records, so a candidate need not be a record.  Records are what is
reachable from the start of a file.  Inside a range the tasks follow the
candidates to where each leaves it; between ranges the pointers are doubled,
so the rounds grow with the logarithm of a file's ranges; then each range
keeps what its one verified entry reaches.  A chain that does not end where
its file ends is an error.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kiln.llm.registry import register
from kiln.llm.tables import bound_batches, forget, join_counted, text_of, written
from kiln.session import delete_scratch, scratch_path

MIN_BYTES = 100        # a smaller payload is never a revisit
MAX_SLOTS = 1 << 26    # bits of the filter of repeated digests (at most 2^20 broadcast words)
SLOTS_PER_KEY = 16

# fixed values of the format
MAGIC = b"WARC/1."
CRLF = b"\r\n"
BREAK = CRLF + MAGIC
END = CRLF + CRLF


# writing ---------------------------------------------------------------------
def _header(kind: str, rid, url, digest, block, extra=()):
    fields = [F.lit(f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: "), rid, F.lit("\r\nWARC-Target-URI: "), url,
              F.lit("\r\nWARC-Payload-Digest: sha256:"), digest, *extra,
              F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
              F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block]
    return F.concat(*fields)


def _http(length):
    return F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    length.cast("string"), F.lit("\r\n\r\n"))


def _urn(page):
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
               payload_col: str = "html", min_bytes: int = MIN_BYTES) -> None:
    """Write a record per row of ``pages`` to the new folder ``path``.

    The payload is the text in UTF-8 (null: empty).  Of rows with equal
    payloads of at least ``min_bytes`` the one with the smallest id (null
    ids last, then the smallest url) is the response and the others revisit
    it; of rows that repeat id and url too, one is the response.  Record IDs
    carry the page id, so rows that repeat an id repeat theirs.  A blank or
    control character of a url is written as %20, a null url as
    ``urn:unknown``.  Other columns are not read.  Payloads that occur once
    do not shuffle: a filter of the repeated digests lets them pass."""
    url = F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("urn:unknown")), r"[\x00-\x20\x7F]", "%20")
    text = text_of(payload_col)
    rows = pages.select(F.col(id_col).alias("page"), url.alias("url"), text.alias("html"),
                        F.octet_length(text).cast("long").alias("bytes"),
                        F.sha2(text.cast("binary"), 256).alias("digest"))
    large = written(rows.filter(F.col("bytes") >= min_bytes).drop("html")
                    .groupBy("digest", "page", "url").agg(F.count(F.lit(1)).alias("rows"),
                                                          F.first("bytes").alias("bytes")), "warc-pages")
    first = F.min(F.struct(F.col("page").isNull().alias("last"), "page", "url"))
    groups = written(large.groupBy("digest").agg(F.sum("rows").alias("copies"), first.alias("keep"))
                     .filter("copies > 1").select("digest", "copies", F.col("keep.page").alias("keep_page"),
                                                  F.col("keep.url").alias("keep_url")), "warc-groups")
    n_groups, n_rows = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("copies"), F.lit(0))).first()
    slots = 64
    while slots < min(MAX_SLOTS, SLOTS_PER_KEY * n_groups):
        slots *= 2
    slot = F.pmod(F.xxhash64("digest"), F.lit(slots))
    words = (groups.select(slot.alias("slot")).groupBy(F.expr("slot div 64").alias("word"))
             .agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("bits")))
    probed = (rows.withColumn("slot", slot).join(F.broadcast(words), F.expr("slot div 64 = word"), "left")
              .withColumn("hit", F.expr(f"bytes >= {min_bytes} and coalesce(getbit(bits, cast(slot % 64 as int)), 0) = 1")))
    once = probed.filter(~F.col("hit")).select("page", "url", "html", "bytes", "digest")
    # a row's part in its group of copies; rows alike are one
    part = join_counted(large, groups, ["digest"], "copies", max(1, n_rows))
    keeps = F.expr("page <=> keep_page and url = keep_url")
    part = written(part.select("digest", "page", "url", "rows", "bytes", "keep_page", keeps.alias("keeps")), "warc-parts")
    key = F.md5(F.concat_ws("\n", "digest", F.coalesce(F.col("page").cast("string"), F.lit("-")), "url").cast("binary"))
    hits = (probed.filter("hit").groupBy(key.alias("key")).agg(*[F.first(c).alias(c) for c in rows.columns])
            .join(part.select(key.alias("key"), "keeps"), "key", "left")
            .filter(F.coalesce("keeps", F.lit(True))).select(*rows.columns))
    response = _header("response", _urn(F.col("page")), F.col("url"), F.col("digest"),
                       F.concat(_http(F.col("bytes")), F.col("html")))
    more = F.col("rows") - F.when(F.col("keeps"), 1).otherwise(0)
    revisits = _repeated(part.withColumn("more", more).filter("more > 0"))
    refers = [F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
                    "\r\nWARC-Refers-To: "), _urn(F.col("keep_page"))]
    revisit = _header("revisit", _urn(F.col("page")), F.col("url"), F.col("digest"), _http(F.col("bytes")), refers)
    (once.unionByName(hits).select(response.alias("value"))
     .unionByName(revisits.select(revisit.alias("value")))
     .write.option("lineSep", END.decode()).text(path))
    forget(large, groups, part)


def _repeated(rows: DataFrame) -> DataFrame:
    """Each row ``more`` times.  Large numbers are dealt over the tasks in
    runs, so that a page repeated without end is not one task's output."""
    run = 4096
    few = rows.filter(F.col("more") <= run)
    many = (rows.filter(F.col("more") > run)
            .withColumn("run", F.explode(F.expr(f"sequence(0L, (more - 1) div {run})")))
            .withColumn("more", F.expr(f"least({run}L, more - run * {run})")).repartition("digest", "page", "url", "run")
            .drop("run"))
    return few.unionByName(many).withColumn("nth", F.explode(F.expr("sequence(1L, more)"))).drop("nth", "more")


# reading ---------------------------------------------------------------------
def _fields(text: bytes):
    """(fields, start of the block, its length) of what follows a magic;
    None when that is not a record header."""
    if text[:3] not in (b"0\r\n", b"1\r\n"):
        return None
    end = text.find(END, 1)
    if end < 0:
        return None
    fields = {}
    for line in text[3:end].split(CRLF):
        name, _, value = line.partition(b":")
        fields[name.strip().lower()] = value.strip()
    length = fields.get(b"content-length", b"")
    return (fields, end + len(END), int(length)) if length.isdigit() else None


def _payload(block: bytes, content_type: bytes) -> bytes:
    if content_type.lower().startswith(b"application/http"):
        head = block.find(END)
        return b"" if head < 0 else block[head + len(END):]
    return block


_PIECE = pa.schema([
    ("file", pa.string()), ("range", pa.int64()), ("seq", pa.int64()), ("at", pa.int64()), ("size", pa.int64()),
    ("next", pa.int64()), ("leaves", pa.int64()), ("block_at", pa.int64()), ("length", pa.int64()),
    ("whole", pa.bool_()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()),
    ("refers_to", pa.string()), ("content_type", pa.string()), ("declared", pa.string()),
    ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("body", pa.binary())])
_PIECE_DDL = ("file string, range long, seq long, at long, size long, next long, leaves long, block_at long, "
              "length long, whole boolean, record_type string, record_id string, target_uri string, "
              "refers_to string, content_type string, declared string, payload_bytes long, "
              "payload_sha256 string, body binary")


def _text_field(fields, name):
    value = fields.get(name)
    return None if value is None else value.decode("utf-8", "replace")


def _piece(file, start, seq, at, value, bodies):
    """One row, offsets counted from the start of the range."""
    first = start == 0 and seq == 0
    size = len(value) + len(BREAK)
    text = value[len(MAGIC):] if first and value.startswith(MAGIC) else value
    magic = at if first else at - len(MAGIC)
    row = dict.fromkeys(_PIECE.names)
    row.update(file=file, range=start, seq=seq, at=magic, size=size, whole=False, body=text if bodies else None)
    found = None if first and text is value else _fields(text)
    if found:
        fields, block, length = found
        row.update(next=magic + len(MAGIC) + block + length + len(END), block_at=block, length=length,
                   whole=block + length <= len(text))
        for name, field in (("record_type", b"warc-type"), ("record_id", b"warc-record-id"),
                            ("target_uri", b"warc-target-uri"), ("refers_to", b"warc-refers-to"),
                            ("content_type", b"content-type"), ("declared", b"warc-payload-digest")):
            row[name] = _text_field(fields, field)
        if row["whole"]:
            payload = _payload(text[block:block + length], fields.get(b"content-type", b""))
            row.update(payload_bytes=len(payload), payload_sha256=hashlib.sha256(payload).hexdigest())
    return row


def _candidates(bodies: bool):
    """(file, range start, piece) rows, in file order inside a range, to
    candidates.  A range's rows leave when it ends, because where a candidate
    leaves it is found from its end backwards; they are headers and numbers
    (and texts only when asked for)."""
    def finish(rows):
        leaves = {}
        for row in reversed(rows):
            if row["next"] is not None:
                row["leaves"] = leaves.get(row["next"], row["next"])
            # a chain that meets a piece without a header ends there, nowhere
            leaves[row["at"]] = row["leaves"]
        for lo in range(0, len(rows), 1000):
            yield pa.RecordBatch.from_pylist(rows[lo:lo + 1000], schema=_PIECE)

    def run(batches):
        key, rows, at = None, [], 0
        for batch in batches:
            for file, start, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if (file, start) != key:
                    yield from finish(rows)
                    key, rows, at = (file, start), [], 0
                row = _piece(file, start, len(rows), at, value.as_py(), bodies)
                at += row["size"]
                rows.append(row)
        yield from finish(rows)
    return run


def _pieces(spark: SparkSession, path, bodies: bool) -> DataFrame:
    """All candidates of the archives, with absolute offsets, the number of
    the piece in its file and the file's end, as a written table."""
    scan = (spark.read.option("lineSep", BREAK.decode()).text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"),
                    F.col("value").cast("binary").alias("value")))
    found = written(scan.mapInArrow(_candidates(bodies), _PIECE_DDL), "warc-pieces")
    sums = found.groupBy("file", "range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("pieces"))
    before = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("file")
    # a row per range of a file: the windows are over numbers of ranges
    base = sums.select("file", "range", (F.sum("bytes").over(before) - F.col("bytes")).alias("base"),
                       (F.sum("pieces").over(before) - F.col("pieces")).alias("first"),
                       (F.sum("bytes").over(whole) - len(BREAK)).alias("end"),
                       F.sum("pieces").over(whole).alias("in_file"))
    moved = {c: F.col(c) + F.col("base") for c in ("at", "next", "leaves")}
    out = found.join(base, ["file", "range"]).withColumns({**moved, "nth": F.col("first") + F.col("seq")}) \
        .drop("base", "first")
    out.scratch = found.scratch
    return out


def _entries(pieces: DataFrame) -> DataFrame:
    """``(file, at)``: where the chain of each file enters its ranges, by
    doubling pointers from the start of the file.  Raises when a chain breaks
    or a file does not begin with a record."""
    nodes = pieces.select("file", "at", "leaves", "end")
    starts = pieces.filter("range = 0 and seq = 0").select("file", F.lit(0).cast("long").alias("at"), "end")
    targets = nodes.select("file", F.col("leaves").alias("at")).distinct().unionByName(starts.select("file", "at")).distinct()
    doors = written(nodes.join(targets, ["file", "at"]), "warc-doors")
    hop = doors.select("file", F.col("at").alias("source"), F.col("leaves").alias("target"))
    arrive = doors.select("file", F.col("at").alias("target"))
    jump = written(hop.join(arrive, ["file", "target"]), "warc-jump")
    reached = written(starts.select("file", "at"), "warc-reached")
    while jump.limit(1).count():
        step = reached.join(jump, (reached["file"] == jump["file"]) & (reached["at"] == jump["source"])) \
            .select(reached["file"], F.col("target").alias("at"))
        more = written(reached.unionByName(step), "warc-reached")
        second = jump.select("file", F.col("source").alias("target"), F.col("target").alias("beyond"))
        longer = written(jump.join(second, ["file", "target"]).select("file", "source", F.col("beyond").alias("target")),
                         "warc-jump")
        forget(reached, jump)
        reached, jump = more, longer
    ends = starts.select("file", "end").join(
        reached.join(doors, ["file", "at"]).filter("leaves = end").select("file").distinct(), "file", "left_anti")
    broken = [r["file"] for r in ends.limit(5).collect()]
    if broken:
        raise ValueError(f"record chain does not reach the end of the file: {broken}")
    forget(doors, jump)
    return reached


def _walk(key, table):
    """The candidates of one range that its entry reaches."""
    at, follow = table.column("at").to_pylist(), table.column("next").to_pylist()
    step = dict(zip(at, follow))
    here, keep = table.column("entry")[0].as_py(), set()
    while here in step:
        keep.add(here)
        here = step[here]
    return table.filter(pa.array([a in keep for a in at])).select(["file", "range", "seq"])


def _join_spans(batches):
    """Records whose payload holds magics, put together from their pieces."""
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            text = BREAK.join(p["body"] for p in row["parts"])
            block = text[row["block_at"]:row["block_at"] + row["length"]]
            payload = _payload(block, (row["content_type"] or "").encode())
            rows.append({"file": row["file"], "at": row["at"], "span_bytes": len(payload),
                         "span_sha256": hashlib.sha256(payload).hexdigest(), "span": payload})
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
            ("file", pa.string()), ("at", pa.int64()), ("span_bytes", pa.int64()), ("span_sha256", pa.string()),
            ("span", pa.binary())]))


def _spans(records: DataFrame, pieces: DataFrame) -> DataFrame:
    """``(file, at, span_bytes, span_sha256, span)`` of records over several
    pieces; ``pieces`` has bodies."""
    place = pieces.select("file", F.col("at").alias("next"), "nth")
    last = records.join(place.withColumnRenamed("nth", "after"), ["file", "next"], "left")
    first = last.join(pieces.select("file", "at", "nth"), ["file", "at"])
    wanted = first.select("file", "at", "block_at", "length", "content_type", F.explode(F.sequence(
        F.col("nth"), F.coalesce("after", "in_file") - 1)).alias("nth"))
    return (wanted.join(pieces.select("file", "nth", "body"), ["file", "nth"])
            .groupBy("file", "at", "block_at", "length", "content_type")
            .agg(F.sort_array(F.collect_list(F.struct("nth", "body"))).alias("parts"))
            .mapInArrow(_join_spans, "file string, at long, span_bytes long, span_sha256 string, span binary"))


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """``(file, offset, record_type, record_id, target_uri, refers_to,
    declared, payload_bytes, payload_sha256[, payload])``: the records of the
    archives under ``path``, in UTF-8 headers and binary payloads.

    A payload is the entity of an ``application/http`` block, else the whole
    block; it may hold magics or whole records.  A file that does not begin
    with a record, or whose chain breaks or ends early, raises ValueError;
    an empty folder gives no rows.  Archives are split like any text file;
    a file compressed as a whole is read by one task."""
    bound_batches(spark)
    pieces = _pieces(spark, path, payloads)
    entries = _entries(pieces)
    entry = pieces.select("file", "range", "at").join(entries, ["file", "at"]) \
        .select("file", "range", F.col("at").alias("entry"))
    reached = (pieces.select("file", "range", "seq", "at", "next").join(entry, ["file", "range"])
               .groupBy("file", "range").applyInArrow(_walk, "file string, range long, seq long"))
    records = written(pieces.drop("body").join(reached, ["file", "range", "seq"]), "warc-records")
    spanning = records.filter(~F.col("whole"))
    if spanning.limit(1).count():
        have = pieces
        if not payloads:
            files = [r["file"] for r in spanning.select("file").distinct().collect()]  # a list of files, as a scan's
            have = _pieces(spark, files, True)
        span = written(_spans(spanning.select("file", "at", "next", "block_at", "length", "content_type", "in_file"), have),
                       "warc-spans")
    else:
        span = spark.createDataFrame([], "file string, at long, span_bytes long, span_sha256 string, span binary")
    out = records.join(span, ["file", "at"], "left") \
        .withColumn("payload_bytes", F.coalesce("payload_bytes", "span_bytes")) \
        .withColumn("payload_sha256", F.coalesce("payload_sha256", "span_sha256"))
    columns = ["file", F.col("at").alias("offset"), "record_type", "record_id", "target_uri", "refers_to", "declared",
               "payload_bytes", "payload_sha256"]
    if payloads:
        block = F.expr("substring(body, cast(block_at + 1 as int), cast(length as int))")
        http = F.lower("content_type").startswith("application/http")
        bodies = pieces.select("file", "range", "seq", "body")
        # the entity is the tail of the block
        own = F.when(http, F.expr("substring(body, cast(block_at + length - payload_bytes + 1 as int), cast(payload_bytes as int))")).otherwise(block)
        out = out.join(bodies, ["file", "range", "seq"]).withColumn(
            "payload", F.when(F.col("whole"), own).otherwise(F.col("span")))
        columns.append("payload")
    return out.select(*columns)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """``records`` with ``full_bytes`` and ``full_sha256``: of the record's
    own payload or, for a revisit, of the response it refers to (the record
    with that ID and the same declared digest; null when there is none).  A
    response whose payload does not have its declared SHA-256 raises."""
    good = (F.col("declared").isNull() | ~F.col("declared").startswith("sha256:")
            | (F.col("declared") == F.concat(F.lit("sha256:"), "payload_sha256")))
    digest = F.when(good, F.col("payload_sha256")).otherwise(
        F.raise_error(F.concat(F.lit("payload differs from its digest: "), F.coalesce("record_id", F.lit("?")))))
    is_revisit = F.coalesce(F.col("record_type") == "revisit", F.lit(False))
    own = records.filter(~is_revisit).withColumns({"full_bytes": F.col("payload_bytes"), "full_sha256": digest})
    revisits = records.filter(is_revisit)
    # a revisit without a reference, or of a record that is not there, finds nothing
    def key(reference):
        return F.md5(F.concat_ws("\n", F.coalesce(reference, F.lit("")), F.coalesce("declared", F.lit(""))).cast("binary"))

    revisits = revisits.withColumn("target_key", key(F.col("refers_to")))
    wanted = revisits.groupBy("target_key").agg(F.count(F.lit(1)).alias("revisits"))
    targets = (own.filter(F.col("record_id").isNotNull()).groupBy(key(F.col("record_id")).alias("target_key"))
               .agg(F.min("full_bytes").alias("full_bytes"), F.min("full_sha256").alias("full_sha256")))
    found = written(wanted.join(targets, "target_key", "left"), "warc-targets")
    back = join_counted(revisits, found, ["target_key"], "revisits", max(1, revisits.count()))
    return own.select(*records.columns, "full_bytes", "full_sha256").unionByName(
        back.select(*records.columns, "full_bytes", "full_sha256"))


@register("op12_warc", sql="""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha256(body) AS payload_digest FROM p),
g AS (SELECT payload_digest, min(page_id) AS keep FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN keep IS NULL OR keep = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN keep <> page_id THEN keep END AS refers_to
FROM d LEFT JOIN g USING (payload_digest)
""")
def op12_warc(spark, sf_dir):
    """The pages written as WARC and read back: per page the size and digest
    of its payload, its record type and the page it revisits."""
    pages = spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet")
    path = scratch_path(spark, "warc")
    write_warc(pages, path)
    records = resolve_revisits(written(read_warc(spark, path, payloads=False), "warc-read"))
    kind = pages.schema["page_id"].dataType.simpleString()

    def page(column):
        return F.expr(f"cast(nullif(regexp_extract({column}, '^<urn:page:(.*)>$', 1), '') as {kind})")

    out = written(records.select(page("record_id").alias("page_id"), F.col("full_bytes").alias("payload_bytes"),
                                 F.col("full_sha256").alias("payload_digest"), "record_type",
                                 page("refers_to").alias("refers_to")), "warc-digest")
    delete_scratch(spark, path)
    return out
