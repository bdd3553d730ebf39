from contextlib import contextmanager

from stonefold.operators.control import Control, behind


def test_a_cycle_runs_behind_its_barrier(spark):
    order = []

    @contextmanager
    def guard():
        order.append("held")
        yield
        order.append("let go")

    def cycle():
        order.append("cycle")
        return spark.range(3)

    assert behind(guard, cycle).count() == 3 and order == ["held", "cycle", "let go"]
    assert behind(lambda: None, cycle) is None and len(order) == 3


def test_commands():
    control = Control({"add": lambda a, b: a + b})
    assert control.handle("add", a=1, b=2) == {"ok": True, "result": 3}
    assert not control.handle("add", a=1)["ok"] and not control.handle("gone")["ok"]
    control.register("gone", lambda: 1)
    assert control.handle("gone")["result"] == 1
