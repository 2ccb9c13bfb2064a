from seqweave.streaming import evaluation


def test_counts_go_on_where_they_stopped(spark, tmp_path):
    schema = "split string, label int, score double"
    table, registry, state = (str(tmp_path / n) for n in ("t", "registry", "state"))
    for rows in ([("a", 1, 0.9), ("a", 0, 0.8), ("b", 1, 0.1)], [("a", 1, 0.7), ("b", None, 0.2)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(table)
        evaluation.ingest(spark, table, schema, registry, state, ["split"])
    got = {r["split"]: (r["tp"], r["fp"], r["fn"], r["tn"], r["unknown"]) for r in evaluation.current(spark, registry, ["split"]).collect()}
    assert got == {"a": (2, 1, 0, 0, 0), "b": (0, 0, 1, 0, 1)}
