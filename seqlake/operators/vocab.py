"""Vocabularies: the enumerated move vocabulary (G1), learned vocabularies,
id assignment in byte order (E3), id -> token decoding (C2) and coverage (D16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlake.functions.text import split_ws
from seqlake.operators.ordered import dense_index

# Special tokens and their ids; ordinary tokens start at 4.
SPECIALS = [("PAD", 0), ("BOS", 1), ("EOS", 2), ("MASK", 3)]
PAD, BOS, EOS, MASK = 0, 1, 2, 3
N_SPECIAL = 4
# Promotion suffixes and the eight knight jumps (file delta, rank delta).
PROMOTIONS = ["q", "r", "b", "n"]
KNIGHT_JUMPS = [(1, 2), (2, 1), (2, -1), (1, -2), (-1, -2), (-2, -1), (-2, 1), (-1, 2)]
# The eight line directions (rook and bishop) of a sliding piece.
LINE_DIRECTIONS = [(1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (1, -1), (-1, 1), (-1, -1)]


def _square(f, r):
    return F.concat(F.char(F.lit(97) + f), (r + 1).cast("string"))


def move_tokens(spark: SparkSession) -> DataFrame:
    """Every geometrically reachable move (G1): 1,968 distinct strings, byte-ordered.

    Built by exploding per-square candidate arrays (no cross join): queen lines
    of 1..7 steps, knight jumps, and promotions (rank 7->8, 2->1, straight or
    diagonal, suffix q/r/b/n).
    """
    sq = spark.range(64).select((F.col("id") % 8).cast("int").alias("f"),
                                (F.col("id") / 8).cast("int").alias("r"))
    offsets = [(df * d, dr * d) for df, dr in LINE_DIRECTIONS for d in range(1, 8)] + KNIGHT_JUMPS
    cand = F.array(*[F.struct(F.lit(a).alias("df"), F.lit(b).alias("dr")) for a, b in offsets])
    targets = F.filter(
        F.transform(cand, lambda o: F.struct((F.col("f") + o["df"]).alias("tf"),
                                             (F.col("r") + o["dr"]).alias("tr"))),
        lambda t: (t["tf"] >= 0) & (t["tf"] < 8) & (t["tr"] >= 0) & (t["tr"] < 8))
    plain = (sq.select("f", "r", F.explode(targets).alias("t"))
               .select(F.concat(_square(F.col("f"), F.col("r")),
                                _square(F.col("t.tf"), F.col("t.tr"))).alias("token")))
    # promotions: from rank 7 (index 6) to 8, or rank 2 (index 1) to 1, file delta -1..1
    promo_from = sq.where(F.col("r").isin(1, 6))
    promo = (promo_from
             .select("f", "r", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("d"))
             .where((F.col("f") + F.col("d") >= 0) & (F.col("f") + F.col("d") < 8))
             .select("f", "r", "d", F.explode(F.array(*[F.lit(p) for p in PROMOTIONS])).alias("p"))
             .select(F.concat(_square(F.col("f"), F.col("r")),
                              _square(F.col("f") + F.col("d"),
                                      F.when(F.col("r") == 6, F.lit(7)).otherwise(F.lit(0))),
                              F.col("p")).alias("token")))
    return plain.union(promo).distinct()


def assign_ids(tokens: DataFrame, token_col: str = "token", n_special: int = N_SPECIAL,
               with_specials: bool = True) -> DataFrame:
    """(token, id): specials first, then ``n_special + rank`` in byte order.

    The rank is a ``dense_index`` (range blocks), so a learned vocabulary of any
    size never passes through one task.
    """
    spark = tokens.sparkSession
    distinct = tokens.select(F.col(token_col).alias("token")).where(F.col("token").isNotNull()).distinct()
    ranked = dense_index(distinct, [F.col("token")], name="_rank")
    vocab = ranked.select("token", (F.col("_rank") + F.lit(n_special)).cast("int").alias("id"))
    if with_specials:
        vocab = spark.createDataFrame(SPECIALS, "token string, id int").unionByName(vocab)
    return vocab


def move_vocabulary(spark: SparkSession) -> DataFrame:
    """The enumerated vocabulary: PAD/BOS/EOS/MASK then 1,968 moves (ids 0..1971)."""
    return assign_ids(move_tokens(spark))


def learned_vocabulary(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Vocabulary of every whitespace token seen in ``text_col``."""
    return assign_ids(docs.select(F.explode(split_ws(text_col)).alias("token")))


def decode_ids(ids_col, tokens: list[str], unknown: str = "?", drop_pad: bool = False,
               first_n: int | None = None):
    """id -> token (C2) as a column expression over a fixed vocabulary.

    ``tokens`` lists a fixed vocabulary in id order (``fixed_tokens`` for the
    moves); it becomes one array literal.  Learned vocabularies are tables and
    go through ``encode.decode_join``.
    """
    arr = F.array(*[F.lit(t) for t in tokens])
    c = F.col(ids_col) if isinstance(ids_col, str) else ids_col
    toks = F.transform(c, lambda i: F.coalesce(F.get(arr, i), F.lit(unknown)))
    if drop_pad:
        toks = F.filter(toks, lambda t: t != F.lit("PAD"))
    if first_n is not None:
        toks = F.slice(toks, 1, first_n)
    return toks


def fixed_tokens(spark: SparkSession) -> list[str]:
    """The 1,972 tokens of the move vocabulary in id order."""
    return [r.token for r in move_vocabulary(spark).orderBy("id").collect()]


def seen_vocab(tokens: DataFrame, vocab: DataFrame, token_col: str = "token") -> DataFrame:
    """Coverage (D16): every vocabulary entry with its occurrence count in ``tokens``
    (0 = unseen).  Map-side partial counts, then one join on the distinct tokens."""
    freq = tokens.groupBy(F.col(token_col).alias("token")).agg(F.count("*").alias("n_seen"))
    return (vocab.join(freq, "token", "left")
                 .select("token", "id", F.coalesce("n_seen", F.lit(0)).cast("bigint").alias("n_seen")))


#: Buckets of a distinct-count sketch as a power of two: 2^14 keep the standard error under 0.9 %.
SKETCH_LG_K = 14


def token_sketches(tokens: DataFrame, by: str, token_col: str = "token", lg_k: int = SKETCH_LG_K) -> DataFrame:
    """D16, monitoring mode: one HyperLogLog sketch of the distinct tokens per ``by``, ``(by, sketch, n_tokens)``.

    A few kilobytes a row whatever the input; written beside the token store, each increment adds its own rows and no
    token is read again (``sketched_vocab``)."""
    return tokens.groupBy(by).agg(F.hll_sketch_agg(token_col, lg_k).alias("sketch"), F.count(token_col).alias("n_tokens"))


def sketched_vocab(sketches: DataFrame, *by: str) -> DataFrame:
    """Distinct tokens, estimated, over all rows of ``token_sketches`` with the same ``by`` (all of them, if none):
    united sketches equal the sketch of the united input."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct"),
                                     F.sum("n_tokens").cast("bigint").alias("n_tokens"))


# -- fixed move vocabulary: arithmetic index, no join ---------------------------------

# Fixed value: shape of a coordinate move (from square, to square, optional promotion).
MOVE_PATTERN = "^[a-h][1-8][a-h][1-8][qrbn]?$"
MOVE_SLOTS = 64 * 64 * 5  # from-square x to-square x (no promotion, q, r, b, n)


def _py_move_index(tok: str) -> int:
    f1, r1, f2, r2 = ord(tok[0]) - 97, int(tok[1]) - 1, ord(tok[2]) - 97, int(tok[3]) - 1
    promo = "qrbn".index(tok[4]) + 1 if len(tok) == 5 else 0
    return ((f1 * 8 + r1) * 64 + (f2 * 8 + r2)) * 5 + promo


def move_index(tok) -> Column:
    """Slot of a coordinate move in ``0..20479`` (only for strings matching MOVE_PATTERN)."""
    t = F.col(tok) if isinstance(tok, str) else tok
    sq = lambda pos: (F.ascii(F.substring(t, pos, 1)) - 97) * 8 + (F.ascii(F.substring(t, pos + 1, 1)) - 49)
    promo = F.when(F.length(t) == 5, F.instr(F.lit("qrbn"), F.substring(t, 5, 1))).otherwise(F.lit(0))
    return (sq(1) * 64 + sq(3)) * 5 + promo


def move_id_table(vocab: DataFrame):
    """Dense slot -> id table (-1 = not a vocabulary move) from the move vocabulary.
    The vocabulary is the fixed enumerated one (1,972 rows), so collecting it is bounded."""
    import numpy as np
    rows = vocab.where(F.col("id") >= N_SPECIAL).select("token", "id").collect()
    if len(rows) > MOVE_SLOTS:
        raise ValueError("not a move vocabulary")
    tab = np.full(MOVE_SLOTS, -1, dtype=np.int32)
    for tok, i in rows:
        tab[_py_move_index(tok)] = i
    return tab


def fixed_move_ids(tokens_col, table) -> Column:
    """C1 fast path for the fixed move vocabulary: token -> id by arithmetic index
    into one array literal (no join, no shuffle, stays in generated code);
    anything that is not a vocabulary move -> NULL."""
    tab = F.lit(table)
    c = F.col(tokens_col) if isinstance(tokens_col, str) else tokens_col
    return F.transform(c, lambda t: F.when(F.regexp_like(t, F.lit(MOVE_PATTERN)),
                                           F.nullif(F.get(tab, move_index(t)), F.lit(-1))))
