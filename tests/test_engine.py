import pytest

from pagelode.plans.engine import Engines


class Broken:
    id = "broken"

    def supports(self, task):
        return task == "search:chunk"

    def run(self, task, payload):
        raise RuntimeError("no such device")


def test_fallback_and_errors(spark):
    engines = Engines()
    engines.register(Broken())
    assert engines.active("search:chunk") == "broken" and engines.active("search:cosine") == "builtin" and engines.active("x") is None
    docs = spark.createDataFrame([(1, "a b c")], "id long, text string")
    got = engines.run_task("search:chunk", {"docs": docs, "keep": ("id",)})
    assert got.success and got.data.count() == 1
    vectors = spark.createDataFrame([(1, [0.0, 1.0])], "id long, embedding array<double>")
    assert engines.run_task("search:quantize", {"vectors": vectors, "dimensions": 2}).data.first()["codes"] == [-128, 127]
    failed = engines.run_task("search:none", {})
    assert not failed.success and "search:none" in failed.error
    with pytest.raises(LookupError):
        engines.run_task("search:none", {}, throw=True)
