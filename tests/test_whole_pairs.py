"""What the state of a pair on a stream holds: one packed value a batch, and nothing of the batch that closes the pair."""

from pyspark.sql import Row

from palimpsest.streaming import pairs as sp


class Handle:
    """Keeps values as the state store does, and counts what is asked of it."""

    def __init__(self):
        self.held, self.count, self.timers = [], None, []

    def getListState(self, name, schema):
        self.rows = type("L", (), {"appendValue": lambda _, v: self.held.append(v), "get": lambda _: iter(list(self.held)), "clear": lambda _: self.held.clear()})()
        return self.rows

    def getValueState(self, name, schema):
        return type("V", (), {"get": lambda _: self.count, "update": lambda _, v: setattr(self, "count", v), "clear": lambda _: setattr(self, "count", None)})()

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


def test_a_pair_is_held_in_one_value_a_batch():
    row = Row(*sp.COLUMNS, "a_rows", "b_rows")
    rows = [row(1, s, i, f"n{i}", "paragraph", None, f"text {i}", 30, 30) for s in "AB" for i in range(30)]
    h, now = Handle(), type("T", (), {"getCurrentProcessingTimeInMs": lambda self: 1000})()
    p = sp.WholePairs(50)
    p.init(h)
    assert list(p.handleInputRows((1,), iter(rows[:20]), now)) == [] and len(h.held) == 1 and h.timers == [1050]
    assert list(p.handleInputRows((1,), iter(rows[20:45]), now)) == [] and len(h.held) == 2 and h.timers == [1050]
    out = list(p.handleInputRows((1,), iter(rows[45:]), now))
    assert [tuple(r) for r in out] == [(*r[:7], True) for r in rows] and out[0].asDict()["text"] == "text 0"
    assert (h.held, h.count, h.timers) == ([], None, [])
    # whole at once: nothing is held
    assert len(list(p.handleInputRows((1,), iter(rows), now))) == 60 and h.held == [] and h.count is None
    # given up
    assert list(p.handleInputRows((1,), iter(rows[:3]), now)) == []
    assert [r.complete for r in p.handleExpiredTimer((1,), now, None)] == [False] * 3 and h.count is None
