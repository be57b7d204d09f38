"""The near-duplicate stage shuffles the texts that it compares, not all texts (third round, pipeline's disk)."""

from __future__ import annotations

from pageloom.llm import simhash


def shuffles(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_texts_that_are_not_compared_stay_where_they_are(spark):
    prints = spark.range(1000).selectExpr("id AS uid", "concat('text ', id) AS text")
    uids = spark.range(0, 1000, 100).toDF("uid")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few, many = simhash._texts_of(prints, uids), simhash._texts_of(prints, uids, most=9)
        assert shuffles(few) == 0 and shuffles(many) > 0
        wanted = {(k, f"text {k}") for k in range(0, 1000, 100)}
        assert {tuple(r) for r in few.collect()} == {tuple(r) for r in many.collect()} == wanted
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_stage_shuffles_less_than_its_texts(spark):
    """Texts of random words of which two are alike: what the stage shuffles is seen by the parts of its plans."""
    seen: list[int] = []

    def join(self, other, *args, **kwargs):
        out = plain(self, other, *args, **kwargs)
        if self.columns == ["uid", "text"] and list(args[1:]) == ["left_semi"]:
            seen.append(shuffles(out))
        return out

    docs = spark.range(200).selectExpr("id AS doc_id", "array_join(transform(sequence(1, 60), x -> hex(xxhash64(id % 199, x))), ' ') AS text")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    kind = type(docs)
    plain = kind.join
    kind.join = join
    try:
        edited = docs.selectExpr("doc_id + 1000 AS doc_id", "concat(text, ' end') AS text").where("doc_id = 1005")
        groups = simhash.similar_groups(docs.unionByName(edited)).collect()
    finally:
        kind.join = plain
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    at = {r.doc_id: r.component_id for r in groups}
    assert at[1005] == 5 and at[199] == 0 and at[7] == 7 and len(at) == 201
    assert seen and not any(seen)
