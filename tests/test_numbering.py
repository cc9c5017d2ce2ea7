from scrivane.operators.numbering import numbered


def test_numbers_are_gapless_in_order(spark):
    rows = [(i * 7919 % 1000, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(7)
    got = {(r.a, r.b): r.number for r in numbered(df, ["a", "b"]).collect()}
    assert [k for k, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(rows) and sorted(got.values()) == list(range(1000))
    assert numbered(df.limit(0), ["a"]).count() == 0
