"""The driver's entry without the training-data part, and the folder that all executors share."""

from __future__ import annotations

import importlib
import sys
from types import SimpleNamespace

import pytest

from punctual import session


@pytest.mark.parametrize("missing", ["public_tokenizers", "punctual.llm", "corpus_pipeline"])
def test_entry_without_a_module(monkeypatch, missing):
    import __spark_entry__ as entry

    importlib.import_module("punctual.plans.catalogue")
    for name in [n for n in sys.modules if n.startswith("punctual.llm") or n in ("corpus_pipeline", "public_tokenizers")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, missing, None)
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert "line_late" in queries and "line_late" in oracles and "pipeline" not in queries
    if missing != "corpus_pipeline":
        assert not any(name.startswith("op") for name in queries)


def cluster(master, **conf):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: conf.get(key, default)), sparkContext=context)


def test_shared_folder():
    warehouse, checkpoint = "spark.sql.warehouse.dir", "spark.checkpoint.dir"
    assert session.shared_folder(cluster("spark://host:1", **{checkpoint: "hdfs:///c/", warehouse: "/w"})) == "hdfs:///c"
    assert session.shared_folder(cluster("yarn", **{warehouse: "s3a://bucket/w"})) == "s3a://bucket/w/scratch"
    assert session.shared_folder(cluster("local[4]", **{warehouse: "file:/w"})) == "file:/w/scratch"
    for path in ("file:/w", "/w", "w"):
        with pytest.raises(RuntimeError):
            session.shared_folder(cluster("spark://host:1", **{warehouse: path}))
