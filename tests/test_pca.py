import numpy as np

from sensorloom.operators import ml


def test_components_over_the_channels_that_are_present(spark):
    rng = np.random.default_rng(0)
    rows = []
    for city, gas in (("a", 1.0), ("b", 0.5), ("c", 0.97)):
        for i in range(400):
            x = rng.normal(size=4)
            x[1] = x[0] + 0.3 * x[1]
            o3 = float(x[3]) if i / 400 < gas else None
            rows.append((city, float(x[0]), float(x[1]), float(x[2]), o3))
    rows += [("d", 1.0, 2.0, 3.0, 4.0)] * 20 + [("e", None, None, None, 1.0)] * 200
    df = spark.createDataFrame(rows, "city string, p double, q double, r double, o3 double")
    names = ["p", "q", "r", "o3"]
    table = ml.pca_by_presence(df, names, "city").collect()
    summary = {r.city: r for r in ml.pca_summary(ml.pca_by_presence(df, names, "city"), "city").collect()}
    # Too few rows, and too few channels, give no components.
    assert {r.city for r in table} == {"a", "b", "c"} == set(summary)
    for city, own in (("a", names), ("b", names[:3]), ("c", names)):
        x = np.array([r[1:] for r in rows if r[0] == city], object)[:, : len(own)]
        x = x[[all(v is not None for v in r) for r in x]].astype(float)
        values, vectors = np.linalg.eigh(np.corrcoef(x.T))
        shares, vectors = values[::-1] / values.sum(), vectors[:, ::-1]
        got = {(r.component, r.channel): r for r in table if r.city == city}
        assert len(got) == len(own) ** 2 and {r.n for r in got.values()} == {len(x)}
        for (c, name), r in got.items():
            assert np.isclose(r.explained_ratio, shares[c - 1])
            assert np.isclose(abs(r.loading), abs(vectors[own.index(name), c - 1]))
        line, sums = summary[city], np.cumsum(shares)
        for t in (0.8, 0.9, 0.95):
            assert line[f"components_{round(100 * t)}"] == np.searchsorted(sums, t) + 1
        for part, c in zip(line.dominant.split("; "), range(3)):
            order = np.argsort(-np.abs(vectors[:, c]))[:2]
            assert set(part.split(": ")[1].split(" and ")) == {own[i] for i in order}
    assert ml.pca_by_presence(df.limit(0), names, "city").count() == 0


def test_a_constant_channel_has_no_share(spark):
    rng = np.random.default_rng(1)
    rows = [("a", float(x), float(y), 5.1) for x, y in rng.normal(size=(200, 2))]
    df = spark.createDataFrame(rows, "city string, p double, q double, r double")
    got = {(r.component, r.channel): r for r in ml.pca(df, ["p", "q", "r"], "city").collect()}
    assert np.isclose(got[2, "p"].cumulative_ratio, 1) and got[3, "p"].explained_ratio < 1e-12
    assert abs(got[1, "r"].loading) < 1e-9
