import pytest

from strandline.operators.graph import frontier
from strandline.operators.rank import retain_latest
from strandline.sources import states


def test_interrupted_crawl_goes_on(spark, tmp_path):
    root = str(tmp_path / "states")
    assert states.load_state(spark, root, "c1") is None

    def urls(*names):
        return spark.createDataFrame([(f"http://h/{n}",) for n in names], "url string")

    pending = frontier(urls("a", "b", "c"), urls("a"))
    assert states.save_state(pending, root, "c1") is None
    assert states.save_state(pending, root, "c1", "never", interrupted=True) is None
    assert states.save_state(pending, root, "c1", interrupted=True)
    again = states.load_state(spark, root, "c1")
    assert sorted(r.url for r in again.collect()) == ["http://h/b", "http://h/c"]
    states.save_state(frontier(again, urls("a", "b")), root, "c1", "always")
    states.save_state(urls("z"), root, "c2", "always")
    assert [r.url for r in states.load_state(spark, root, "c1").collect()] == ["http://h/c"]
    found = states.saved_states(spark, root)
    assert found.count() == 3
    assert sorted(r.crawl_id for r in retain_latest(found, 1).collect()) == ["c1", "c2"]
    with pytest.raises(ValueError):
        states.save_state(pending, root, "c1", "sometimes")
