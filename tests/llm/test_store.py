from urllib.parse import urlparse

import pytest

from gramweave.llm import store


def test_finished_tables_are_deleted(spark):
    kept, gone = store.written(spark.range(5).repartition(2), "kept"), store.written(spark.range(7), "gone")
    places = [[urlparse(f).path for f in df.inputFiles()] for df in (kept, gone)]
    assert gone.count() == 7
    store.dropped(gone)
    from os.path import exists

    assert all(map(exists, places[0])) and not any(map(exists, places[1])) and kept.count() == 5


def test_executors_need_a_shared_folder(monkeypatch):
    class Conf:
        def get(self, key, default):
            return default

    class Context:
        applicationId, master = "app-of-this-test", "local-cluster[3,2,1000]"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        store.shared_dir(Session())
