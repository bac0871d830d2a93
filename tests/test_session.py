import os

import pytest

from codeweave import session


def test_tables_are_stored_and_discarded(spark):
    stored = session.materialize(spark.range(5), "five")
    path = stored._stored_in
    assert path.startswith(session.shared_folder(spark)) and os.path.isdir(path) and stored.count() == 5
    session.discard(stored)
    session.discard(spark.range(1))
    assert not os.path.exists(path)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Conf:
        def get(self, key, default):
            return None

    class Fake:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://somewhere:7077", "applicationId": "a"})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Fake())
