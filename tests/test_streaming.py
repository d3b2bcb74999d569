import json

from lumenflow.streaming import reanalysis


def test_batches_add_up(spark, tmp_path):
    incoming, store, checkpoint = (str(tmp_path / x) for x in ("in", "store", "checkpoint"))
    (tmp_path / "in").mkdir()

    def arrive(name, *rows):
        (tmp_path / "in" / name).write_text("\n".join(json.dumps(dict(zip(("method", "category", "api"), r))) for r in rows))
        reanalysis.keep(spark, incoming, store, checkpoint).awaitTermination()
        return sorted((r["method"], r["categories"], r["n_apis"]) for r in reanalysis.collaborations(spark, store).collect())

    assert arrive("a.json", ("m", "x", "1"), ("m", "x", "1"), ("k", "x", "1")) == []
    assert arrive("b.json", ("m", "y", "2"), ("m", "x", "1")) == [("m", "x,y", 2)]
    assert arrive("c.json", ("k", "z", "3")) == [("k", "x,z", 2), ("m", "x,y", 2)]
