"""Plan checks: pushed filters, pruned columns, broadcast lookups, no single-partition exchange."""

from pyspark.sql import functions as F

from seqlake.operators.encode import lookup_ids
from seqlake.operators.ordered import dense_index
from seqlake.plans.registry import table

SF = "/root/testdata/sf0.001"


def plan(df):
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def test_filter_pushed_and_columns_pruned(spark):
    li = table(spark, SF, "lineitem").where(F.col("l_quantity") > 10).select("l_orderkey")
    p = plan(li)
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)]" in p
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in p


def test_vocab_lookup_is_broadcast(spark):
    vocab = spark.createDataFrame([("a", 4), ("b", 5)], "token string, id int")
    seqs = spark.createDataFrame([(1, ["a", "b"])], "k long, tokens array<string>")
    p = plan(lookup_ids(seqs, "k", "tokens", vocab))
    assert "BroadcastHashJoin" in p or "BroadcastExchange" in p


def test_dense_index_has_no_single_partition(spark):
    df = table(spark, SF, "orders").select("o_orderkey")
    p = plan(dense_index(df, ["o_orderkey"]))
    assert "SinglePartition" not in p


def test_top_n_per_owner_limits_before_shuffle(spark):
    from seqlake.operators.split import random_pick
    cust = table(spark, SF, "customer").select("c_nationkey", "c_custkey")
    p = plan(random_pick(cust, "c_custkey", 3, 42, owner="c_nationkey"))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_count_scan_reads_no_columns(spark):
    import __spark_entry__ as E
    p = plan(E.queries()["count_scan"](spark, SF))
    assert "ReadSchema: struct<>" in p and "RoundRobinPartitioning" not in p


def test_scoring_is_in_row(spark):
    from pyspark.sql import functions as F
    from seqlake.operators.scoring import sample_topk, topk_legal
    from seqlake.plans.scoring_plans import scoring_rows
    r = scoring_rows(spark, SF)
    p = plan(r.select("vec_id", topk_legal("logits", "legal", 5, 1.0).alias("t"),
                      sample_topk("logits", "legal", 3, 0.6, 42, "vec_id").alias("s")))
    assert "hashpartitioning" not in p and "Join" not in p and "Generate" not in p


def test_fixed_vocabulary_encode_has_no_exchange(spark):
    from seqlake.operators.encode import encode_fixed
    from seqlake.operators.vocab import move_id_table, move_vocabulary
    df = spark.createDataFrame([(1, ["a1a2", "h8h7"]), (1, ["a1a1"]), (2, [])], "k int, tokens array<string>")
    out = encode_fixed(df, "tokens", move_id_table(move_vocabulary(spark)), keep_rejects=True)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert sorted(str((r.k, r.ids, r.reject_reason)) for r in out.collect()) == sorted(map(str, [
        (1, [1, 4, 1971, 2], None), (1, None, "unknown_token"), (2, None, "empty")]))
