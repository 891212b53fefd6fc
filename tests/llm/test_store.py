from pathlib import Path

from tidemill.llm import store


def test_tables_in_the_shared_folder_and_their_removal(spark):
    df = store.written(spark.range(5), "five")
    path = store._made[-1]
    assert df.count() == 5 and path.startswith(store.shared_folder(spark)) and Path(path.removeprefix("file:")).exists()
    store.clear(spark)
    assert not store._made and not Path(path.removeprefix("file:")).exists()
