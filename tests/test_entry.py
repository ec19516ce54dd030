"""The queries against DuckDB, and the contract without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import sampleloom.queries as Q

REPO, DATA = Path(__file__).resolve().parents[1], "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["welford_merge_shards", "normalized_label_profile", "pad_reflect", "compose_chain", "early_stopping_windows", "collate_batches", "fft_shift", "low_pass_steep", "welford_offset", "welford_tensor", "early_stopping_nan", "row_axis_blocks", "color_jitter_contrast", "color_jitter_hue", "rgb_to_hsv", "rotate_30", "jpeg_gray", "audio_flac", "audio_float_wav", "meta_values"])
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "events", "documents"):
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    want = con.sql(Q.ORACLE_SQL[name]).df()
    got = Q.QUERIES[name](spark, DATA).toPandas()[list(want.columns)]
    key = lambda d: sorted(map(str, d.itertuples(index=False)))
    assert key(got) == key(want)


@pytest.mark.parametrize("name", ["gaussian_blur", "resize_round_trip", "linear_run", "cosine_of_crop"])
def test_kernel_queries_compute_in_doubles(spark, name):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{DATA}/embeddings.parquet')")
    want = con.sql(Q.ORACLE_SQL[name]).df()
    got = Q.QUERIES[name](spark, DATA).toPandas()[list(want.columns)]
    both = want.merge(got, on=["vec_id", "pos"], suffixes=("", "_got"))
    assert len(both) == len(want) == len(got) and (both["value"] == both["value_got"]).all()


def test_entry_without_the_subpackage(tmp_path):
    for p in ("__spark_entry__.py", "sampleloom"):
        (shutil.copytree if (REPO / p).is_dir() else shutil.copy)(REPO / p, tmp_path / p)
    shutil.rmtree(tmp_path / "sampleloom/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and set(e.oracle_sql()) <= set(q) and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
