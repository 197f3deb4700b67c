"""Token-level jobs over whole documents: term counts and lexicon scoring."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.operators.joins import BROADCAST_MAX_BYTES
from kiln.operators.layout import joins_by_some_keys
from kiln.operators.scratch import store
from kiln.session import ensure_checkpoint_dir

ENTRY_BYTES = 64     # of a lexicon entry besides its key
BLOCK_BYTES = 16 << 20  # of text whose documents share the entries of their keys
TOKEN_SPLIT = r"[^\p{L}]+"   # a token is a maximal run of letters


def tokens(text: str | Column) -> Column:
    """Lower-cased letter runs of the whole text (empty pieces dropped)."""
    t = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(t), TOKEN_SPLIT), lambda s: s != "")


def explode_tokens(df: DataFrame, id_col: str, text_col: str, out: str = "term") -> DataFrame:
    return df.select(id_col, F.explode(tokens(text_col)).alias(out))


def term_counts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per term: documents (rows) containing it and total occurrences.  A row
    gives its tokens and, beside them, its distinct tokens; one partially
    aggregated exchange, by term, counts both."""
    toks = df.select(tokens(text_col).alias("_t"))
    both = (toks.select(F.posexplode(F.array("_t", F.array_distinct("_t"))).alias("_kind", "_terms"))
            .select("_kind", F.explode("_terms").alias("term")))
    return both.groupBy("term").agg(F.count(F.when(F.col("_kind") == 1, 1)).alias("n_docs"),
                                    F.count(F.when(F.col("_kind") == 0, 1)).alias("n_total"))


def read_lexicon(spark, path: str) -> DataFrame:
    """A ``word<TAB>score`` lexicon file (phrases allowed)."""
    return (spark.read.option("sep", "\t").schema("term string, score int").csv(path)
            .withColumn("term", F.lower("term")))


def _gram_pattern(n: int) -> str:
    """Regex over the space-joined tokens: at every token start, capture
    (in a lookahead, so matches overlap) the run of ``n`` tokens there."""
    return r"(?<!\S)(?=(\S+" + (r"(?: \S+){%d}" % (n - 1) if n > 1 else "") + "))"


def gram_arrays(toks: str, joined: str, lengths) -> list[Column]:
    """Per length n (sorted): the keys of all runs of n consecutive tokens in
    text order (tokens joined by one space), as plain array/regex
    expressions inside whole-stage code generation (no lambda per token).
    ``joined`` = ``array_join(toks, ' ')``, projected once by the caller."""
    return [F.col(toks) if n == 1 else F.regexp_extract_all(F.col(joined), F.lit(_gram_pattern(n)), 1)
            for n in sorted(lengths)]


def ngrams(toks: str, joined: str, lengths) -> Column:
    """Keys of all runs of n consecutive tokens, n in ``lengths``."""
    return F.concat(*gram_arrays(toks, joined, lengths))


def lexicon_keys(lexicon: DataFrame, term_col: str = "term", score_col: str = "score") -> DataFrame:
    """Lexicon entries in token form: ``key`` = the entry's tokens joined by
    one space, ``n`` = its token count.  ``cover-up`` and ``can't stand``
    become the phrases ``cover up`` and ``can t stand``, so an entry matches
    exactly where the document tokenizer produces its words.  Entries that
    normalise to the same key keep the score of the smallest original text."""
    toks = lexicon.select(tokens(term_col).alias("_toks"), F.col(score_col).cast("bigint").alias("score"),
                          F.col(term_col).alias("_term"))
    return (toks.select(F.array_join("_toks", " ").alias("key"), F.size("_toks").alias("n"), "score", "_term")
            .filter(F.col("n") > 0)
            .groupBy("key", "n").agg(F.min_by("score", "_term").alias("score")))


def derive_lexicon(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   flag_col: str = "toxic", min_docs: int = 3, clip: int = 5, max_words: int = 1) -> DataFrame:
    """Integer term scores in [-clip, clip] from labelled documents: rounded
    log-odds of a term occurring in flagged vs. unflagged documents
    (add-one smoothed); terms in fewer than ``min_docs`` labelled documents
    and zero scores are dropped.  A term is a run of 1..``max_words``
    consecutive tokens (``max_words`` > 1 adds phrases)."""
    lab = docs.join(labels.select(id_col, F.col(flag_col).alias("_flag")), id_col)
    totals = lab.agg(F.sum("_flag").alias("n_pos"), F.count(F.lit(1)).alias("n_all")).first()
    n_pos, n_neg = int(totals["n_pos"] or 0), int(totals["n_all"] - (totals["n_pos"] or 0))
    lab = lab.select(id_col, "_flag", tokens(text_col).alias("_toks"))
    if max_words > 1:
        lab = lab.withColumn("_joined", F.array_join("_toks", " "))
    terms = F.col("_toks") if max_words == 1 else ngrams("_toks", "_joined", range(1, max_words + 1))
    present = lab.select(id_col, "_flag", F.explode(F.array_distinct(terms)).alias("term"))
    stats = present.groupBy("term").agg(F.sum("_flag").alias("pos"), F.count(F.lit(1)).alias("df"))
    odds = F.log(((F.col("pos") + 1) / (F.col("df") - F.col("pos") + 1)) * F.lit((n_neg + 1) / (n_pos + 1)))
    score = F.greatest(F.lit(-clip), F.least(F.lit(clip), F.round(odds, 0).cast("int")))
    lexicon = (stats.filter(F.col("df") >= min_docs).select("term", score.alias("score"))
               .filter(F.col("score") != 0))
    # a derived model table: written once (size check, broadcast and any
    # later use read the materialised rows instead of re-aggregating)
    ensure_checkpoint_dir(docs.sparkSession)
    return lexicon.checkpoint(eager=True)


@dataclass
class PreparedLexicon:
    """A lexicon ready for scoring: ``entries`` = ``(key, score)`` plus, when
    it holds phrases, ``(in_score, in_count)`` of the lexicon words inside
    each entry; ``lengths`` = the entry lengths; ``size`` = its bytes."""
    entries: DataFrame
    lengths: list
    size: int

    def persist(self) -> "PreparedLexicon":
        """Kept and materialised, for a stream that scores every micro-batch
        with it (release with ``unpersist``)."""
        self.entries = self.entries.persist()
        self.entries.count()
        return self

    def unpersist(self) -> None:
        self.entries.unpersist()


def prepare_lexicon(lexicon: DataFrame) -> PreparedLexicon:
    """Normalised entries, their lengths and size (one job), and for phrase
    lexicons the score and count of the lexicon words inside each phrase
    (computed once per entry, not per document)."""
    lex = lexicon_keys(lexicon)
    st = lex.agg(F.sum(F.octet_length("key") + ENTRY_BYTES).alias("size"),
                 F.array_sort(F.collect_set("n")).alias("lengths")).first()
    lengths = [int(v) for v in st["lengths"]]
    if lengths in ([], [1]):
        return PreparedLexicon(lex.select("key", "score"), lengths, int(st["size"] or 0))
    words = lex.filter(F.col("n") == 1).select(F.col("key").alias("_w"), F.col("score").alias("_ws"))
    inner = (lex.filter(F.col("n") > 1).select("key", F.explode(F.split("key", " ")).alias("_w"))
             .join(words, "_w", "left")
             .groupBy("key").agg(F.sum(F.coalesce("_ws", F.lit(0))).alias("in_score"),
                                 F.count("_ws").alias("in_count")))
    entries = (lex.join(inner, "key", "left")
               .select("key", "score", F.coalesce("in_score", F.lit(0)).cast("bigint").alias("in_score"),
                       F.coalesce("in_count", F.lit(0)).cast("bigint").alias("in_count")))
    return PreparedLexicon(entries, lengths, int(st["size"] or 0))


def score_documents(docs: DataFrame, lexicon: DataFrame | PreparedLexicon, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Lexicon score of every whole document: ``score`` = sum of the matched
    entries' scores, ``n_matched`` = number of matches; documents without a
    match score 0.

    Entries may be phrases.  The text is read left to right; at each token
    the longest entry starting there matches and its tokens are consumed,
    so ``not good`` is scored as the phrase, never also as ``good``.  With
    single-word entries only this is the plain sum over token occurrences.

    Which phrases the scan takes depends on the phrase matches alone (a
    single word never blocks a later phrase), and a word counts unless a
    taken phrase covers it.  So single words are summed by partial
    aggregation; only a document's phrase matches go through the
    left-to-right fold, each carrying the score and count of the lexicon
    words inside it, which the fold takes back when it takes the phrase."""
    prep = lexicon if isinstance(lexicon, PreparedLexicon) else prepare_lexicon(lexicon)
    if prep.size <= BROADCAST_MAX_BYTES:  # broadcast only behind the measured bytes
        toks = docs.select(id_col, tokens(text_col).alias("_toks"))
        hits = _keys(toks, [id_col], prep.lengths).join(F.broadcast(prep.entries), "key")
        per_doc = _sums(hits, [id_col], prep.lengths)
    else:
        per_doc = _sums_in_blocks(docs, prep, id_col, text_col)
    return (docs.select(id_col).join(per_doc, id_col, "left")
            .select(id_col, F.coalesce("score", F.lit(0)).cast("bigint").alias("score"),
                    F.coalesce("n_matched", F.lit(0)).cast("bigint").alias("n_matched")))


def _keys(toks: DataFrame, by: list, lengths: list) -> DataFrame:
    """Every key of the tokens ``_toks``, with its place where there are
    phrases."""
    if lengths in ([], [1]):
        return toks.select(*by, F.explode("_toks").alias("key"))
    # one pass per document: all keys of every length in one array; a
    # key's length is its word count, its start follows from the offsets
    # of the concatenation (len(tokens) - m + 1 keys of each length m)
    toks = toks.select(*by, "_toks", F.array_join("_toks", " ").alias("_joined"))
    grams = toks.select(*by, F.size("_toks").alias("_nt"),
                        F.posexplode(ngrams("_toks", "_joined", lengths)).alias("_p", "key"))
    n = F.length("key") - F.length(F.translate("key", " ", "")) + 1
    offset = F.lit(0)
    for m in lengths[:-1]:
        offset = offset + F.when(n > m, F.greatest(F.col("_nt") - m + 1, F.lit(0))).otherwise(0)
    return grams.select(*by, (F.col("_p") - offset + 1).alias("pos"), n.alias("n"), "key")


def _sums(hits: DataFrame, by: list, lengths: list) -> DataFrame:
    """Score and matches per document."""
    if lengths in ([], [1]):
        # partial aggregation before the shuffle: one row per document and task
        return hits.groupBy(*by).agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("n_matched"))
    word = F.col("n") == 1
    # per document: the word sums, and its phrase matches (at most
    # lengths x its tokens) in text order, longest first at a position
    per_doc = hits.groupBy(*by).agg(
        F.sum(F.when(word, F.col("score"))).alias("_ws"),
        F.count(F.when(word, F.lit(1))).alias("_wc"),
        F.collect_list(F.when(~word, F.struct("pos", (-F.col("n")).alias("neg_n"), "score", "in_score",
                                             "in_count"))).alias("_m"))
    zero = F.struct(F.lit(0).alias("next"), F.lit(0).cast("bigint").alias("score"),
                    F.lit(0).cast("bigint").alias("n_matched"))
    walk = F.aggregate(F.array_sort("_m"), zero, lambda acc, m: F.when(
        m["pos"] >= acc["next"],
        F.struct((m["pos"] - m["neg_n"]).alias("next"),
                 (acc["score"] + m["score"] - m["in_score"]).alias("score"),
                 (acc["n_matched"] + 1 - m["in_count"]).alias("n_matched"))).otherwise(acc))
    return per_doc.select(*by, "_ws", "_wc", walk.alias("_w")).select(
        *by, (F.coalesce("_ws", F.lit(0)) + F.col("_w.score")).alias("score"),
        (F.col("_wc") + F.col("_w.n_matched")).alias("n_matched"))


def _sums_in_blocks(docs: DataFrame, prep: PreparedLexicon, id_col: str, text_col: str) -> DataFrame:
    """The sums under a lexicon beyond a broadcast.  Documents are dealt once,
    by id, to blocks of about BLOCK_BYTES of text and kept there; a block's
    distinct keys meet the lexicon, and what they find comes back to the
    block.  Neither the keys of single documents nor their matches move."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    count = max(1, -(-size // BLOCK_BYTES))
    tasks = max(2 * count, int(spark.conf.get("spark.sql.shuffle.partitions")))  # few blocks share one
    laid = (docs.select(id_col, F.pmod(F.xxhash64(id_col), F.lit(count)).cast("int").alias("_block"),
                        F.array_join(tokens(text_col), " ").alias("_joined"))
            .filter("_joined <> ''").repartition(tasks, "_block").persist(StorageLevel.DISK_ONLY))
    laid.count()  # a kept plan's partitioning is known once it has run
    keys = _keys(laid.select("_block", F.split("_joined", " ").alias("_toks")), ["_block"], prep.lengths)
    found = keys.select("_block", "key").distinct().repartition(tasks, "key").join(prep.entries, "key")
    every = _keys(laid.select("_block", id_col, F.split("_joined", " ").alias("_toks")), ["_block", id_col], prep.lengths)
    with joins_by_some_keys(spark):
        hits = every.join(found.hint("shuffle_hash"), ["_block", "key"])
        per_doc = store(_sums(hits, ["_block", id_col], prep.lengths).drop("_block"), "scores")
    laid.unpersist()
    return per_doc
