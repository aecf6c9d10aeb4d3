import importlib
import types

import pytest

import __spark_entry__ as entry
from clueforge import session


class _Conf:
    def get(self, _name, default=None):
        return default


class _Cluster:
    conf = _Conf()

    class sparkContext:  # noqa: N801
        master = "spark://somewhere:7077"

        class _jsc:  # noqa: N801
            @staticmethod
            def sc():
                class C:
                    @staticmethod
                    def getCheckpointDir():  # noqa: N802
                        class O:
                            @staticmethod
                            def isDefined():  # noqa: N802
                                return False

                        return O

                return C


def test_no_machine_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError):
        session.scratch_dir(_Cluster)


@pytest.mark.parametrize("missing, silent", [("clueforge.llm", True), ("clueforge.llm.queries", True), ("clueforge.llm.names", False), ("tiktoken", False), ("clueforge.plans.links", False)])
def test_only_the_whole_subpackage_may_be_absent(monkeypatch, missing, silent):
    real = importlib.import_module

    def load(name):
        if name == entry.LLM and missing != "clueforge.plans.links" or name == missing:
            raise ModuleNotFoundError(missing, name=missing)
        return real(name)

    monkeypatch.setattr(entry, "importlib", types.SimpleNamespace(import_module=load))
    if silent:
        assert len(entry._modules()) == len(entry.CORE)
    else:
        with pytest.raises(ModuleNotFoundError):
            entry._modules()


def test_shuffle_files_are_released_between_parts(spark):
    import time

    from clueforge.session import durable, release

    files = lambda: sum(1 for p in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "/shuffle_" in p)
    release(spark)
    time.sleep(2)
    before = files()
    written = durable(spark.range(20_000).selectExpr("id", "repeat('x', 50) as t").repartition(3, "id"), "released")
    assert files() > before
    for _ in range(20):
        release(spark)
        time.sleep(0.5)
        if files() <= before:
            break
    assert files() <= before and written.count() == 20_000
