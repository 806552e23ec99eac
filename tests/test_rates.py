from gridpulse.operators.series import instant_rate


def test_samples_with_one_time_have_no_rate(spark):
    df = spark.createDataFrame([("a", 10, 5.0), ("a", 10, 5.0), ("a", 20, 8.0)], "host string, epoch long, n double")
    got = [r.rate for r in instant_rate(df, "n", 60, ["host"]).orderBy("epoch", "rate").collect()]
    assert None in got and 0.3 in [round(r, 6) for r in got if r is not None]
