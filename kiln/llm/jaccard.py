"""N-gram Jaccard join: grouped prefix join.

A document is its set of word k-shingles.  Two sets with Jaccard similarity
at least t share a token among the first ``n - ceil(t n) + 1`` of each, for
any one order of the tokens.  The order here puts tokens that crowd the
prefixes last (a fixed-size bit table, so its broadcast is bounded) and takes
the rest by hash, so the lists of documents that share a prefix token stay
short.

Documents with identical prefix and size are one group.  The list of each
prefix token pairs groups of fitting sizes; the pairs are expanded to the
members (distinct sets), filtered by the distance of 1,024-bit parity sketches
(a lower bound of the symmetric difference, so nothing is lost), and verified
on the whole sets.

Pairs are never all emitted.  A pair counts in one list only as far as the
first FIRST listed tokens of both tell: a list leaves a pair to an earlier
common one.  A list first gives a minimum spanning forest of
its surviving pairs (closest first); after these are verified and the sets
linked so far are known, it gives what survives between different components.
Each link is thus either verified or inside a component, and what leaves a
list is linear in its length wherever the sets are alike.  A list longer than
LIST_BLOCK is dealt to tasks in pairs of blocks.

Verification groups the pairs by the smallest set key two steps around them,
so a set travels once to a bucket of pairs, not once for each pair.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm import grams as G
from kiln.llm.registry import register
from kiln.llm.tables import documents, fresh, join_counted, packed, text_of, written
from kiln.operators.graph import connected_components

SHINGLE, NUM, DEN = 4, 85, 100
CROWDED = 64            # groups on a prefix token from which on it goes last
MAX_CROWDED = 1 << 20   # the limit rises so that no more tokens than this can pass it
CROWD_BITS = 1 << 23
SKETCH_WORDS = 16       # 1,024 bits
MEMBERS = 64            # members of a group entry; larger groups have several
LIST_BLOCK = 4096
BROADCAST_ROWS = 200_000
TOKEN_BITS = 1 << 24    # bit table of the tokens with a list: 2 MB, whatever the corpus
FIRST = 4
BUCKET_SETS = 1000
FOREST_BUFFER = 1 << 20
_U = np.uint64


def prefix_length(n, num=NUM, den=DEN):
    return n - -(-n * num // den) + 1


def shingle_sets(data, offs, k):
    """Per row the sorted distinct shingle hashes of a chunk (A-Z lower-cased;
    fewer than k words: the whole sequence is one shingle)."""
    part = G.LOWER[data]
    starts, ends, woff = G.word_spans(part, offs, G.SPACE)
    words = G.word_hashes(part, starts, ends)
    spans = G.Spans(words)
    all_grams = spans.rolling(k)
    for lo, hi in zip(woff[:-1], woff[1:]):
        n = hi - lo
        if n >= k:
            yield np.unique(all_grams[lo:hi - k + 1])
        elif n:
            yield spans.hash(np.array([lo]), np.array([hi]))
        else:
            yield np.zeros(0, _U)


def sketch(tokens):
    """Parity of the tokens on each of 1,024 bits."""
    bits = np.bincount((tokens & _U(1023)).astype(np.int64), minlength=1024) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def set_key(tokens):
    """128-bit key of a set."""
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _rows_of(batch):
    data, offs = G.unpacked(batch.column(batch.num_columns - 1))
    for lo, hi in G.chunks(offs):
        yield lo, hi, data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]


def _hash_prefixes(k, num, den):
    """(text) -> (prefix): prefixes in plain hash order."""
    def run(batches):
        for batch in batches:
            for _, _, data, offs in _rows_of(batch):
                prefixes = [t[:prefix_length(len(t), num, den)] for t in shingle_sets(data, offs, k) if len(t)]
                flat = np.concatenate([np.zeros(0, _U), *prefixes])
                yield pa.RecordBatch.from_arrays([pa.array(G.as_long(flat), pa.int64())], names=["token"])
    return run


def _ordered_prefixes(k, num, den, crowded):
    """(doc_id, row_key, text) -> the set's key, size, group, sketch and
    prefix in the order (crowded, hash)."""
    def run(batches):
        table = crowded.value
        rid = TaskContext.get().partitionId() << 40  # numbers the rows; the table is written once
        for batch in batches:
            for lo, hi, data, offs in _rows_of(batch):
                keys, sizes, groups, sketches, prefixes = [], [], [], [], []
                for tokens in shingle_sets(data, offs, k):
                    n = len(tokens)
                    sizes.append(n)
                    if not n:
                        keys.append(None), groups.append(None), sketches.append(None)
                        prefixes.append(tokens)
                        continue
                    late = in_table(table, tokens)
                    prefix = np.concatenate([tokens[~late], tokens[late]])[:prefix_length(n, num, den)]
                    keys.append(set_key(tokens))
                    groups.append(set_key(np.concatenate([prefix, np.array([n], _U)])))
                    sketches.append(sketch(tokens))
                    prefixes.append(prefix)
                flat = np.concatenate([np.zeros(0, _U), *prefixes])
                rids = np.arange(rid, rid + hi - lo)
                rid += hi - lo
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(rids),
                     pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(groups, pa.binary()),
                     pa.array(sketches, pa.binary()),
                     G.row_lists(np.array([len(p) for p in prefixes], np.int64), pa.array(G.as_long(flat), pa.int64()))],
                    names=["doc_id", "row_key", "rid", "set_key", "n", "gid", "sketch", "prefix"])
    return run


def bit_table(values: DataFrame, bits: int) -> np.ndarray:
    """A table of ``bits`` bits, set at each ``token mod bits``: at most
    ``bits / 64`` words reach the driver, however many tokens there are."""
    words = (values.select(F.pmod("token", F.lit(bits)).alias("bit")).distinct()
             .groupBy(F.expr("cast(bit div 64 as int)").alias("word"))
             .agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits")).toPandas())
    out = np.zeros(bits // 64, _U)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(_U)
    return out


def in_table(table: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    bit = tokens & _U(len(table) * 64 - 1)
    return (table[(bit >> _U(6)).astype(np.int64)] >> (bit & _U(63))) & _U(1) == 1


def crowded_tokens(text: DataFrame, k, num, den) -> np.ndarray:
    """Bit table of the tokens on the hash-order prefixes of many rows.  Any
    table gives a valid order, so one bit for several tokens, or copies that
    count each, lose nothing."""
    tokens = (text.mapInArrow(_hash_prefixes(k, num, den), "token long")
              .groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= CROWDED))
    tokens = written(tokens, "tokens")
    limit = CROWDED
    total = tokens.count()
    while total > MAX_CROWDED:
        limit *= 2
        tokens = tokens.filter(F.col("n") >= limit)
        total = tokens.count()
    return bit_table(tokens, CROWD_BITS)


def _listed(bits):
    """(entry, k, prefix) -> flat (token, pos, entry, k) of the tokens that
    may have a list."""
    def run(batches):
        table = bits.value
        for batch in batches:
            lists = batch.column(2)
            offsets = lists.offsets.to_numpy()
            tokens = lists.flatten().to_numpy().view(_U)
            row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            pos = np.arange(len(tokens)) - (offsets[:-1] - offsets[0])[row]
            ok = in_table(table, tokens)
            take = pa.array(row[ok])
            yield pa.RecordBatch.from_arrays(
                [pa.array(G.as_long(tokens[ok]), pa.int64()), pa.array(pos[ok].astype(np.int32)),
                 batch.column(0).take(take), batch.column(1).take(take)], names=["token", "pos", "entry", "k"])
    return run


class _Forest:
    """Minimum spanning forest of the pairs of one list, kept small."""

    def __init__(self, limit=FOREST_BUFFER):
        self.limit, self.parts, self.held = limit, [], 0

    def add(self, a, b, cost):
        self.parts.append((a, b, cost))
        self.held += len(a)
        if self.held > self.limit:
            self.parts = [self.edges()]
            self.held = len(self.parts[0][0])

    def edges(self):
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        a, b, cost = (np.concatenate([p[i] for p in self.parts]) for i in range(3))
        order = np.lexsort((b, a, cost))
        parent: dict[int, int] = {}

        def root(x):
            while parent.get(x, x) != x:
                parent[x] = x = parent.get(parent[x], parent[x])
            return x

        keep = []
        for e in order.tolist():
            x, y = root(int(a[e])), root(int(b[e]))
            if x != y:
                parent[y] = x
                keep.append(e)
        return a[keep], b[keep], cost[keep]


def _list_pairs(token, n, side, sketches, comp, first, pos, num, den):
    """Surviving pairs of rows sorted by (token, n): same token, other
    component (when given), other side of a block pair, no earlier common
    list, sizes that can reach the similarity, sketches close enough.
    ``first`` are the first listed tokens of each row (0 where there is
    none), ``pos`` the place of this list among them.  Yields index arrays
    and cost."""
    idx = np.arange(len(token))
    d = 0
    while len(idx):
        d += 1
        idx = idx[idx + d < len(token)]
        j = idx + d
        ok = (token[idx] == token[j]) & (den * n[idx] >= num * n[j])
        idx, j = idx[ok], j[ok]
        if not len(idx):
            return
        use = side[idx] != side[j]
        use |= side[idx] < 0
        if comp is not None:
            use &= comp[idx] != comp[j]
        a, b = idx[use], j[use]
        for lo in range(0, len(a), 1 << 16):
            x, y = a[lo:lo + (1 << 16)], b[lo:lo + (1 << 16)]
            ham = np.bitwise_count(sketches[x] ^ sketches[y]).sum(axis=1, dtype=np.int64)
            near = ham * (den + num) <= (n[x] + n[y]) * (den - num)
            if not near.any():
                continue
            x, y, ham = x[near], y[near], ham[near]
            earlier = np.zeros(len(x), bool)
            for i in range(first.shape[1]):
                token_x = first[x, i]
                known = (token_x != 0) & (i < pos[x])
                for j in range(first.shape[1]):
                    earlier |= known & (token_x == first[y, j]) & (j < pos[y])
            if not earlier.all():
                x, y, ham = x[~earlier], y[~earlier], ham[~earlier]
                yield x, y, ham / (n[x] + n[y])


def _pairs(num, den, forest):
    """(part, n, side, rank, first, members) sorted by part -> (a, b)."""
    def handle(table):
        members = table.column("members").combine_chunks()
        count = np.diff(members.offsets.to_numpy())
        flat = members.flatten()
        group = np.repeat(np.arange(len(table)), count)
        token = np.unique(table.column("part").to_numpy(), return_inverse=True)[1][group]
        n = table.column("n").to_numpy()[group]
        side = table.column("side").to_numpy()[group]
        pos = table.column("rank").to_numpy()[group]
        firsts = table.column("first").combine_chunks()
        have = np.diff(firsts.offsets.to_numpy())
        first = np.zeros((len(table), FIRST), np.int64)
        row = np.repeat(np.arange(len(table)), have)
        first[row, np.arange(len(row)) - np.repeat(np.cumsum(have) - have, have)] = firsts.flatten().to_numpy()
        first = first[group]
        keys = np.array(flat.field("set_key").to_pylist(), dtype=object)
        raw = b"".join(flat.field("sketch").to_pylist())
        sketches = np.frombuffer(raw, _U).reshape(-1, SKETCH_WORDS)
        comp = None
        if not forest:
            comp = np.unique(np.array(flat.field("comp").to_pylist(), dtype=object), return_inverse=True)[1]
        order = np.lexsort((n, token))
        token, n, side, keys, sketches = token[order], n[order], side[order], keys[order], sketches[order]
        first, pos = first[order], pos[order]
        comp = comp[order] if comp is not None else None
        ids = np.unique(keys, return_inverse=True)[1]
        out = _Forest()
        pairs: set = set()
        span = len(ids) + 1
        for x, y, cost in _list_pairs(token, n, side, sketches, comp, first, pos, num, den):
            lo, hi = np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])
            distinct = lo != hi
            if forest:
                # nodes are (list, set): every list has a forest of its own
                out.add(token[x[distinct]] * span + lo[distinct], token[x[distinct]] * span + hi[distinct],
                        cost[distinct])
            else:
                pairs.update(zip(lo[distinct].tolist(), hi[distinct].tolist()))
        if forest:
            a, b, _ = out.edges()
            pairs = set(zip((a % span).tolist(), (b % span).tolist()))
        names = np.empty(int(ids.max()) + 1 if len(ids) else 0, dtype=object)
        names[ids] = keys
        pairs = sorted(pairs)
        return pa.RecordBatch.from_arrays(
            [pa.array([names[a] for a, _ in pairs], pa.binary()), pa.array([names[b] for _, b in pairs], pa.binary())],
            names=["a", "b"])

    def run(batches):
        # whole lists: a list that a batch cuts waits for its rest; a list
        # has at most about 2 * LIST_BLOCK entries
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            parts = table.column("part")
            last = parts[len(table) - 1]
            cut = len(table) - 1
            while cut > 0 and parts[cut - 1] == last:
                cut -= 1
            held = table.slice(cut)
            if cut:
                yield handle(table.slice(0, cut))
        if held is not None and len(held):
            yield handle(held)
    return run


def _candidates(entries: DataFrame, num, den, forest: bool) -> DataFrame:
    """Distinct pairs ``(a, b)`` of set keys out of the token lists."""
    spark = entries.sparkSession
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (entries.repartition(shuffled, "part").sortWithinPartitions("part")
            .select("part", "n", "side", "rank", "first", "members")
            .mapInArrow(_pairs(num, den, forest), "a binary, b binary").distinct())


def long_sketch(tokens) -> bytes:
    """Parity of the tokens on the next power of two of at least 4 bits for
    each, after the set's size (8 bytes)."""
    bits = 1 << max(10, int(4 * len(tokens) - 1).bit_length())
    parity = np.bincount((tokens & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.array([len(tokens)], _U).tobytes() + np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()


def _near(num, den):
    """Whether two long sketches allow the similarity: the larger is folded
    to the size of the smaller, and their distance is a lower bound of the
    symmetric difference."""
    def near(x, y):
        n, a, b = int(x[0]) + int(y[0]), x[1:], y[1:]
        while len(a) > len(b):
            a = a[:len(a) // 2] ^ a[len(a) // 2:]
        while len(b) > len(a):
            b = b[:len(b) // 2] ^ b[len(b) // 2:]
        return int(np.bitwise_count(a ^ b).sum()) * (den + num) <= n * (den - num)
    return near


def _similar(num, den):
    def similar(x, y):
        both = len(np.intersect1d(x, y, assume_unique=True))
        return den * both >= num * (len(x) + len(y) - both)
    return similar


def _set_rows(k, form):
    """(buckets, text) -> ``form`` of the text's set, a row for each bucket."""
    def run(batches):
        for batch in batches:
            buckets = batch.column(0).to_pylist()
            for lo, _, data, offs in _rows_of(batch):
                out = [(b, set_key(t), form(t)) for i, t in enumerate(shingle_sets(data, offs, k)) if len(t)
                       for b in buckets[lo + i]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary()),
                     pa.array([x[2] for x in out], pa.binary())], names=["bucket", "set_key", "tokens"])
    return run


def _verify(holds):
    def run(key, pairs: pa.Table, sets: pa.Table) -> pa.Table:
        have = {k: np.frombuffer(t, _U) for k, t in zip(sets.column("set_key").to_pylist(),
                                                      sets.column("tokens").to_pylist())}
        ok = [holds(have[x], have[y]) for x, y in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist())]
        return pairs.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
    return run


def _bucketed(pairs: DataFrame) -> DataFrame:
    """``a, b, bucket``: pairs that lie close together share a bucket.  The
    key of a pair is the smallest set key within two steps; a key with many
    pairs is split by hash."""
    ends = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"))
    ends = ends.union(ends.select(F.col("y").alias("x"), F.col("x").alias("y")))
    one = ends.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("low"))
    near = one.withColumnRenamed("x", "y").withColumnRenamed("low", "l")
    two = ends.join(near, "y").groupBy("x").agg(F.min("l").alias("low"))
    low = written(two, "low")
    keyed = (pairs.join(low.select(F.col("x").alias("a"), F.col("low").alias("la")), "a")
             .join(low.select(F.col("x").alias("b"), F.col("low").alias("lb")), "b")
             .select("a", "b", F.least("la", "lb").alias("key")))
    counts = keyed.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BUCKET_SETS).alias("parts"))
    return (keyed.join(counts, "key")
            .select("a", "b", F.xxhash64("key", F.pmod(F.xxhash64("a"), "parts")).alias("hash")))


def _verified(pairs: DataFrame, rows: DataFrame, text: DataFrame, k, num, den) -> DataFrame:
    """The pairs whose whole sets reach the similarity.  Long sketches, a
    sixteenth of the sets, go first: the short ones of the lists are full for
    long texts.  What they leave is verified on the sets."""
    near = written(_held_by(pairs, rows, text, k, long_sketch, _near(num, den)), "near")
    return _held_by(near, rows, text, k, np.ndarray.tobytes, _similar(num, den))


def _held_by(pairs: DataFrame, rows: DataFrame, text: DataFrame, k, form, holds) -> DataFrame:
    """The pairs that ``holds`` accepts, on ``form`` of both sets.  Only the
    texts of candidates are read again, one row for each distinct set, and a
    set goes once to each bucket of pairs that needs it."""
    buckets = max(1, -(-pairs.count() // BUCKET_SETS))
    dealt = written(_bucketed(pairs).select("a", "b", F.pmod("hash", F.lit(buckets)).alias("bucket")), "dealt")
    needed = (dealt.select("bucket", F.explode(F.array("a", "b")).alias("set_key"))
              .groupBy("set_key").agg(F.collect_set("bucket").alias("buckets")))
    one = written(rows.filter("n > 0").groupBy("set_key").agg(F.min("row_key").alias("row_key"))
                  .join(needed, "set_key").select("row_key", "buckets"), "needed")
    if (one.agg(F.sum(F.size("buckets") + 4)).first()[0] or 0) <= 4 * BROADCAST_ROWS:  # at most 8 bytes each
        one = F.broadcast(one)
    else:
        text = packed(text.select("row_key", "text"))
    sets = (text.join(one, "row_key").select("buckets", "text")
            .mapInArrow(_set_rows(k, form), "bucket long, set_key binary, tokens binary"))
    return dealt.groupBy("bucket").cogroup(sets.groupBy("bucket")).applyInArrow(
        _verify(holds), "a binary, b binary")


def jaccard_components(docs: DataFrame, id_col="doc_id", text_col="text", k=SHINGLE, num=NUM, den=DEN):
    """``(doc_id, row_key, set_key, n)`` of every row, written, and
    ``(set_key, component)`` of the sets with links."""
    key = F.unhex(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("\n"), text_of(text_col))
                        .cast("binary")))
    source = docs.select(F.col(id_col).alias("doc_id"), key.alias("row_key"), text_of(text_col).alias("text"))
    spark = docs.sparkSession
    crowded = spark.sparkContext.broadcast(crowded_tokens(source.select("text"), k, num, den))
    kind = source.schema["doc_id"].dataType.simpleString()
    rows = written(source.mapInArrow(
        _ordered_prefixes(k, num, den, crowded),
        f"doc_id {kind}, row_key binary, rid long, set_key binary, n long, gid binary, sketch binary, prefix array<long>"), "sets")
    groups = (rows.filter("n > 0").groupBy("gid")
              .agg(F.first("n").alias("n"), F.min("rid").alias("rid"),
                   F.array_sort(F.collect_set(F.struct("set_key", "sketch"))).alias("m"))
              .select("gid", "n", "rid", F.posexplode(F.transform(
                  F.sequence(F.lit(0), F.size("m") - 1, F.lit(MEMBERS)), lambda i: F.slice("m", i + 1, MEMBERS)))
                  .alias("chunk", "members")))
    # the id of an entry: should two ever share one, they only share lists
    groups = written(groups.withColumn("entry", F.xxhash64("gid", "chunk")), "groups")
    # each group's prefix once, from its first row
    extra = written(rows.filter("n > 0").select("rid").join(groups, "rid", "left_anti"), "extra")
    extra = F.broadcast(extra) if extra.count() <= BROADCAST_ROWS else extra
    prefixes = (rows.filter("n > 0").select("gid", "rid", "prefix").join(extra, "rid", "left_anti")
                .select("gid", "prefix"))
    sizes = groups.select("gid", "entry", F.size("members").alias("k"))
    # most groups have one member and so one entry: only the others are joined
    many = sizes.groupBy("gid").agg(F.sum("k").alias("all")).filter("all > 1").select("gid")
    several = sizes.join(many, "gid")
    plain = prefixes.join(many, "gid", "left_anti").select(
        F.xxhash64("gid", F.lit(0)).alias("entry"), F.lit(1).alias("k"), "prefix")
    tokens = plain.unionByName(prefixes.join(several, "gid").select("entry", "k", "prefix"))
    lists = written(tokens.select(F.explode("prefix").alias("token"), "k").groupBy("token")
                    .agg(F.sum("k").alias("size")).filter("size > 1"), "lists")
    bits = spark.sparkContext.broadcast(bit_table(lists, TOKEN_BITS))
    own_list = F.pmod(F.xxhash64("entry"), F.col("blocks")).cast("int")
    held = (tokens.select("entry", "k", "prefix").mapInArrow(_listed(bits), "token long, pos int, entry long, k int")
            .join(lists.select("token", F.ceil(F.col("size") / LIST_BLOCK).cast("int").alias("blocks")), "token"))
    # the first listed tokens of an entry, in the order of its prefix
    held = held.groupBy("entry").agg(F.array_sort(F.collect_list(F.struct("pos", "token", "blocks"))).alias("all"))
    listed = (held.select("entry", F.slice(F.transform("all", lambda t: t["token"]), 1, FIRST).alias("first"),
                          F.posexplode("all").alias("rank", "t"))
              .select("entry", "first", "rank", "t.token", "t.blocks").withColumn("own", own_list)
              # an entry of a long list goes to each pair of blocks that holds its own
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("entry", "first", "rank",
                      F.xxhash64("token", F.least("own", "other"), F.greatest("own", "other")).alias("part"),
                      F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own")).alias("side")))
    listed = written(listed, "listed")
    entries = listed.join(groups.select("entry", "n", "members"), "entry")
    first = written(_candidates(entries, num, den, forest=True), "pairs")
    links = written(_verified(first, rows, source, k, num, den), "links")
    comp = written(connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))), "comp")
    # what survives between components: exact, and little
    flat = groups.select("entry", "n", F.explode("members").alias("m")).select("entry", "n", "m.*")
    flat = flat.join(comp.withColumnRenamed("node", "set_key"), "set_key", "left")
    named = flat.groupBy("entry", "n").agg(F.collect_list(F.struct(
        "set_key", "sketch", F.coalesce("component", "set_key").alias("comp"))).alias("members"))
    second = written(_candidates(listed.join(named, "entry"), num, den, forest=False)
                     .join(first, ["a", "b"], "left_anti"), "pairs")
    if not second.isEmpty():
        more = written(_verified(second, rows, source, k, num, den), "links")
        if not more.isEmpty():
            links = links.unionByName(more)
            comp = written(connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))), "comp")
    return rows.select("doc_id", "row_key", "set_key", "n"), comp.withColumnRenamed("node", "set_key")


def jaccard_join(docs: DataFrame, id_col="doc_id", text_col="text", k=SHINGLE, num=NUM, den=DEN) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``.

    Null text counts as empty; a text without words has no shingles, no
    links and its own id as component.  Copies have equal sets and so one
    component; repeated ids are rows of their own; a null id is in a
    component but never names one (all ids null: the component is null).
    Only the id and text columns are read.  An empty table gives no rows."""
    rows, comp = jaccard_components(docs, id_col, text_col, k, num, den)
    named = (rows.filter("n > 0").groupBy("set_key").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("copies"))
             .join(comp, "set_key", "left").withColumn("c", F.coalesce("component", "set_key")))
    lowest = named.groupBy("c").agg(F.min("low").alias("component_id"))
    by_set = written(named.join(lowest, "c").select("set_key", "copies", "component_id"), "by_set")
    linked = (join_counted(rows.filter("n > 0"), by_set, ["set_key"], "copies", rows.count())
              .select("doc_id", F.col("n").alias("n_shingles"), "component_id"))
    alone = rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def keep_one(docs: DataFrame, id_col="doc_id", text_col="text", k=5, num=80, den=100) -> DataFrame:
    """The documents with one row (of the smallest id) of each component, all
    columns; texts without words all stay."""
    rows, comp = jaccard_components(docs, id_col, text_col, k, num, den)
    sets = (rows.filter("n > 0").groupBy("set_key").agg(F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "row_key")).alias("low"))
            .join(comp, "set_key", "left").withColumn("c", F.coalesce("component", "set_key")))
    stays = sets.groupBy("c").agg(F.min("low").alias("stay")).select("stay.row_key")
    kept = rows.filter("n > 0").join(stays, "row_key", "left_semi").groupBy("row_key").agg(F.count(F.lit(1)).alias("r"))
    kept = written(kept, "kept")
    key = fresh(docs, "row_key")
    here = F.unhex(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("\n"), text_of(text_col))
                         .cast("binary")))
    gone = (rows.filter("n > 0").join(kept, "row_key", "left_anti").select("row_key")
            .union(kept.filter("r > 1").select("row_key")).distinct().withColumnRenamed("row_key", key))
    keyed = docs.withColumn(key, here)
    gone = written(gone, "gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    out = keyed.join(gone, key, "left_anti")
    again = kept.filter("r > 1").select(F.col("row_key").alias(key))
    if not again.isEmpty():  # rows that repeat both id and text: one of them
        out = out.unionByName(keyed.join(again, key, "left_semi").dropDuplicates([key]))
    return out.drop(key)


@register("op3_jaccard_join", sql=r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT rn, array_to_string(w[i:i + 3], ' ') AS g
      FROM (SELECT rn, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT rn, count(*) AS n FROM s GROUP BY rn),
p AS (SELECT x.rn AS a, y.rn AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.rn <> y.rn GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.rn = a JOIN n nb ON nb.rn = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
reach(a, b) AS (SELECT rn, rn FROM d UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(t.doc_id) AS component_id
FROM d LEFT JOIN n USING (rn) JOIN reach ON reach.a = d.rn JOIN d t ON t.rn = reach.b GROUP BY d.rn, d.doc_id
""")
def op3_jaccard_join(spark, sf_dir):
    return jaccard_join(documents(spark, sf_dir))
