import os

import pytest

from conftest import REFERENCE

DATA = f"{REFERENCE}/data/C3-D20-I100"


@pytest.mark.skipif(not os.path.exists(DATA), reason="reference data absent")
def test_cli_linkage_then_evaluate(spark, tmp_path):
    from dendrospark.cli import main
    from dendrospark.sources.io import read_merges
    main(["linkage", DATA, str(tmp_path / "m"), "--k", "3"])
    merges = read_merges(spark, str(tmp_path / "m"))
    assert merges.count() == 297
    main(["evaluate", DATA, str(tmp_path / "m"), str(tmp_path / "r"), "--k-min", "3", "--k-max", "4"])
    rep = spark.read.option("header", "true").csv(str(tmp_path / "r")).collect()
    assert [int(r.k) for r in rep] == [3, 4]
    assert float(rep[0].silhouette) == pytest.approx(0.952035, abs=1e-6)


def test_cli_on_files_of_its_own(spark, tmp_path):
    """Three far groups in two files; the same ids however they are split."""
    import numpy as np

    from dendrospark.cli import main
    from dendrospark.sources.io import read_merges
    rng = np.random.default_rng(4)
    rows = [f"{x:.3f},{y:.3f}" for c in (0, 50, 90) for x, y in rng.normal(c, 0.2, (6, 2))]
    data = tmp_path / "data"
    data.mkdir()
    (data / "part-0.csv").write_text("\n".join(rows[:5]) + "\n")
    (data / "part-1.csv").write_text("\n".join(rows[5:]) + "\n")
    main(["linkage", str(data), str(tmp_path / "m"), "--k", "3"])
    merges = read_merges(spark, str(tmp_path / "m"))
    assert sorted(r.cluster for r in merges.collect()) == list(range(19, 34))
    main(["evaluate", str(data), str(tmp_path / "m"), str(tmp_path / "r"), "--k-min", "3", "--k-max", "4"])
    rep = spark.read.option("header", "true").csv(str(tmp_path / "r")).collect()
    assert [int(r.k) for r in rep] == [3, 4] and float(rep[0].silhouette) > 0.99
