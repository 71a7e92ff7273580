"""Profiles against plain sequential loops."""

import math

import numpy as np
import pandas as pd
import pytest

from telvane.operators.online_profile import fit_devices, online_scores
from telvane.operators.profile import FrozenProfiles
from telvane.schema import ProfilePreset
from telvane.streaming import alerts, online

FEATURES = ["x", "y"]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    n = 900
    device = np.where(rng.random(n) < 0.6, "hot", np.where(rng.random(n) < 0.8, "mid", "rare"))
    x = rng.normal(10, 3, n)
    return pd.DataFrame({
        "device_id": device, "ts": pd.to_datetime("2024-01-01") + pd.to_timedelta(rng.permutation(n), unit="m"), "row_id": [f"{i:04d}" for i in range(n)],
        "label": (rng.random(n) < 0.15).astype(int), "x": x, "y": 0.5 * x + rng.normal(size=n),
    })


def sequential_online(pdf, learn_all=True):
    """The recursion row by row: buffer, smoothed mean and std, covariance of the buffer."""
    out = {}
    for _, group in pdf.sort_values(["ts", "row_id"]).groupby("device_id"):
        buffer, mean, std, cov = [], None, None, None
        for r in group.itertuples():
            v = np.array([r.x, r.y])
            if learn_all or r.label == 0:
                buffer = (buffer + [v])[-100:]
                data = np.array(buffer)
                if len(buffer) >= 10:
                    m, s = data.mean(axis=0), data.std(axis=0) + 1e-8
                    mean, std = (m, s) if mean is None else (0.1 * m + 0.9 * mean, 0.1 * s + 0.9 * std)
                if len(buffer) >= 20:
                    cov = np.cov(data.T) + np.eye(2) * 1e-6
            z = 0.0 if mean is None else float(np.mean(np.abs((v - mean) / (std + 1e-8))))
            m = 0.0 if cov is None else float(math.sqrt(max((v - mean) @ np.linalg.pinv(cov) @ (v - mean), 0.0)))
            out[r.row_id] = (z, m, cov is not None)
    return out


def close(got, expected):
    assert set(got) == set(expected)
    for k, (z, m, warm) in expected.items():
        assert got[k][0] == pytest.approx(z, abs=1e-7) and got[k][1] == pytest.approx(m, abs=1e-6) and got[k][2] == warm


def collected(df):
    return {r["row_id"]: (r["deviation_zscore_mean"], r["mahalanobis_dist"], r["is_warm"]) for r in df.collect()}


@pytest.mark.parametrize("max_rows", [None, 150])
def test_batch_form_equals_the_recursion(spark, rows, max_rows):
    """With 150 rows per chunk the hot device is cut, yet nothing changes."""
    close(collected(online_scores(spark.createDataFrame(rows), FEATURES, max_rows=max_rows)), sequential_online(rows))


@pytest.mark.parametrize("learn", ["all", "normal"])
def test_stream_over_several_batches_equals_the_recursion(spark, rows, tmp_path, learn):
    ordered = rows.sort_values(["ts", "row_id"])
    folder = tmp_path / "in"
    folder.mkdir()
    for i, part in enumerate(np.array_split(np.arange(len(ordered)), 3)):
        spark.createDataFrame(ordered.iloc[part]).coalesce(1).write.parquet(str(tmp_path / f"tmp{i}"))
        source = next((tmp_path / f"tmp{i}").glob("*.parquet"))
        (folder / f"{i}.parquet").write_bytes(source.read_bytes())
    schema = spark.read.parquet(str(folder)).schema
    stream = alerts.read_files(spark, str(folder), schema, files_per_trigger=1)
    close(collected(alerts.run_to_table(online.online_stream(stream, FEATURES, learn=learn))), sequential_online(rows, learn == "all"))


def test_device_states(spark, rows):
    got = {r["device_id"]: r for r in fit_devices(spark.createDataFrame(rows), FEATURES).collect()}
    assert {d: r["n_updates"] for d, r in got.items()} == rows.groupby("device_id").size().to_dict()
    hot = rows[rows["device_id"] == "hot"].sort_values(["ts", "row_id"])[FEATURES].to_numpy()
    assert np.allclose(np.array(got["hot"]["cov"]), np.cov(hot[-100:].T) + np.eye(2) * 1e-6)


def frozen_reference(pdf, preset):
    normal = pdf[pdf["label"] == 0].sort_values(["ts", "row_id"])

    def stats(part):
        data = part[FEATURES].to_numpy()[-preset.window:]
        mean = data[0]
        for v in data[1:]:
            mean = preset.alpha * v + (1 - preset.alpha) * mean
        cov = np.cov(data.T) + np.eye(2) * preset.ridge
        return mean, data.std(axis=0) + 1e-8, np.linalg.pinv(cov), len(data)

    fallback = stats(normal)
    own = {d: stats(g) for d, g in normal.groupby("device_id")}
    own = {d: s for d, s in own.items() if s[3] >= preset.warm_up}
    out = {}
    for r in pdf.itertuples():
        mean, std, inv, _ = own.get(r.device_id, fallback)
        diff = np.array([r.x, r.y]) - mean
        out[r.row_id] = (np.mean(np.abs(diff / std)), math.sqrt(max(diff @ inv @ diff, 0)))
    return out, set(own)


@pytest.mark.parametrize("preset", [ProfilePreset(), ProfilePreset(window=60, warm_up=40), ProfilePreset(window=25, warm_up=50)])
@pytest.mark.parametrize("broadcast", [True, False])
def test_frozen_profiles(spark, rows, preset, broadcast, monkeypatch):
    """Includes warm_up > window, where no device is warm and all rows use the fallback."""
    monkeypatch.setattr("telvane.operators.profile.BROADCAST_BYTES", 64 << 20 if broadcast else 0)
    df = spark.createDataFrame(rows)
    profiles = FrozenProfiles.fit(df, FEATURES, preset)
    expected, warm = frozen_reference(rows, preset)
    assert {r["device_id"] for r in profiles.table.collect()} == warm
    for r in profiles.score(df).collect():
        assert (r["z"], r["maha"]) == (pytest.approx(expected[r["row_id"]][0], abs=1e-8), pytest.approx(expected[r["row_id"]][1], abs=1e-8))
