"""Plan shape: pruning and pushdown reach the Parquet scan, the index build does not shuffle."""

from pyspark.sql import functions as F

from mailsift.operators import criteria as C
from mailsift.operators.delta import LogIndex, as_adds
from mailsift.operators.ingest import build_postings, load_index, rebuild_index, write_postings
from mailsift.operators.search import search
from mailsift.session import new_scratch_path
from mailsift.sources.adapters import mail_conv, mail_docs
from tests.conftest import SF001


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_search_pushes_mailbox_and_prunes_field(spark):
    ix = load_index(spark, rebuild_index(mail_conv(spark, SF001), new_scratch_path(spark, "ix")))
    df = search(ix.postings, ix.state, "3", [C.body_contains("the")])
    plan = plan_text(df)
    assert "PartitionFilters: [isnotnull(field" in plan and "(field" in plan and "= BODY)" in plan
    assert "EqualTo(mailbox_id,3)" in plan and "StringContains(term,THE)" in plan
    assert plan.count("Exchange") == 1          # only the distinct


def test_postings_build_has_no_shuffle_for_large_inputs(spark):
    p = build_postings(mail_docs(spark, SF001, with_flags=False))
    assert "Exchange" not in plan_text(p)


def test_clustered_postings_write(spark):
    p = build_postings(mail_conv(spark, SF001))
    path = write_postings(p, new_scratch_path(spark, "clustered"), cluster_partitions=4)
    back = spark.read.parquet(path)
    assert back.count() == p.count()
    # each mailbox sits in few files: one per field folder, two where it straddles a range cut
    files = back.select("mailbox_id", F.input_file_name().alias("f")).distinct() \
        .groupBy("mailbox_id").count().agg(F.max("count")).first()[0]
    assert files <= 2 * 8


def test_small_batch_leaves_the_indexed_postings_in_place(spark):
    ix = LogIndex(spark, new_scratch_path(spark, "log-index"))
    docs = mail_docs(spark, SF001, with_flags=False)
    ix.append(as_adds(docs, 0))
    ix.compact()
    ix.append(as_adds(docs.where(F.col("uid") < 5), 1))
    plan = plan_text(ix.postings().where((F.col("field") == "BODY") & F.col("term").contains("THE")))
    assert "PushedFilters: [IsNotNull(term), StringContains(term,THE)" in plan
    # the filtered postings meet broadcast tombstones; nothing but their keys is shuffled
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert all("term" not in line for line in exchanges) and "BroadcastHashJoin" in plan
    assert "SortMergeJoin" not in plan


def test_messages_added_once_are_no_tombstones(spark):
    ix = LogIndex(spark, new_scratch_path(spark, "log-index"))
    docs = mail_docs(spark, SF001, with_flags=False)
    ix.append(as_adds(docs, 0))
    ix.append(as_adds(docs.where(F.col("uid") < 5), 1).withColumn("op", F.lit("delete")))
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "6000")  # below the folded rows, above the deletes
    try:
        live = ix.postings()
        plan = plan_text(live)
        assert "SortMergeJoin" not in plan and not [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "term" in x]
        want = build_postings(docs.where(F.col("uid") >= 5)).select(live.columns)
        assert live.exceptAll(want).count() == want.exceptAll(live).count() == 0 < want.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)


def test_conjunction_filters_the_state_scan_and_positive_trees_skip_it(spark):
    ix = load_index(spark, rebuild_index(mail_conv(spark, SF001), new_scratch_path(spark, "ix")))
    both = plan_text(ix.search("3", [C.body_contains("the"), C.uid_eq(1)], match="all"))
    assert "EqualTo(uid,1)" in both
    terms = [C.body_contains("the"), C.header_exists("Cc")]
    positive = ix.search("3", terms, match="all")
    assert "Join" not in plan_text(positive)
    one, two = ({tuple(r) for r in ix.search("3", [t]).collect()} for t in terms)
    assert {tuple(r) for r in positive.collect()} == one & two


def rows_scanned(df):
    """Rows that the Parquet scans of ``df`` hand on after skipping row groups."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_a_message_and_a_term_are_read_from_the_files_that_hold_them(spark):
    messages = mail_docs(spark, SF001, with_flags=False).withColumn("mailbox_id", F.lit("hot"))
    path = write_postings(build_postings(messages.repartitionByRange(8, "uid")), new_scratch_path(spark, "blooms"))
    body = spark.read.parquet(path).where("field = 'BODY'")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # with it the scans are inside query stages
    try:
        total = body.count()
        uid = body.agg(F.max("uid")).first()[0] // 2
        term = body.groupBy("term").count().orderBy("count", "term").first()[0]
        message, one, none = body.where(F.col("uid") == uid), body.where(F.col("term") == term), body.where("term = 'NOSUCHTERM'")
        assert 0 < message.count() and rows_scanned(message) < total / 4
        assert 0 < one.count() and rows_scanned(one) < total / 4
        assert rows_scanned(none) == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_compacting_clusters_the_postings(spark):
    ix = LogIndex(spark, new_scratch_path(spark, "log-index"))
    docs = mail_docs(spark, SF001, with_flags=False)
    for k in range(3):
        ix.append(as_adds(docs.where(F.col("uid") % 3 == k).repartition(4), k))
    before = {tuple(r) for r in ix.postings().collect()}
    ix.compact()
    after = ix.postings()
    assert {tuple(r) for r in after.collect()} == before
    files = after.where("field = 'BODY'").select("mailbox_id", "uid", F.input_file_name().alias("f")).distinct()
    assert files.count() == files.select("mailbox_id", "uid").distinct().count()
