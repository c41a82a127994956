"""The ensemble of encoders over a packet table."""

from __future__ import annotations

import pytest

from __spark_entry__ import queries
from tidewatch.operators import anomaly as A
from tidewatch.operators import incstats as I

SF = "/root/testdata/sf0.001"


def test_registered_scores_train_on_the_whole_range(spark, tables):
    """55,000 packets map and train the ensemble, as in the operator; a table of fewer packets is in training."""
    rows = queries()["encoder_ensemble_scores"](spark, SF).collect()
    assert len(rows) == tables.packets.count() < A.MAP_ROWS + A.TRAIN_ROWS
    assert all((r.is_training, r.rmse, r.label, r.probability) == (True, 0.0, 1, 0.5) for r in rows)


def test_scores_write_only_the_training_range(tables, monkeypatch):
    """Vectors of the range come from the range alone; the others are scored as they come."""
    written, keep = [], A.materialize
    monkeypatch.setattr(A, "materialize", lambda df, name: written.append(keep(df, name)) or written[-1])
    got = {r.pkt_no: r for r in A.ensemble_scores(tables.packets, 100, 200).collect()}
    assert len(got) == tables.packets.count() and max(w.count() for w in written if "x" in w.columns) == 300
    whole = I.packet_vectors(tables.packets)
    want = A.EncoderEnsemble.fit(whole, "pkt_no", "vector", 100, 200).score(whole, "vector", "pkt_no", 300).collect()
    for r in want:
        assert (got[r.pkt_no].is_training, got[r.pkt_no].label) == (r.is_training, r.label)
        assert got[r.pkt_no].rmse == pytest.approx(r.rmse, rel=1e-6, abs=1e-12)


def test_a_scored_stream_writes_no_vectors_beyond_the_range(spark, tables, tmp_path):
    """The vectors of later packets are scored as they come."""
    from tidewatch.sources.streams import file_stream
    from tidewatch.streaming import snapshots

    source, folder = str(tmp_path / "in"), str(tmp_path / "state")
    tables.packets.coalesce(1).write.parquet(source)
    assert snapshots.stream_ensemble(file_stream(spark, source, tables.packets.schema), 100, 200, folder=folder).count() == 1_000
    held = [f.parent for f in (tmp_path / "state").rglob("*.parquet") if "vector" in spark.read.parquet(str(f)).columns]
    assert sum(spark.read.parquet(str(f)).count() for f in set(held)) == 300
