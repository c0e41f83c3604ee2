"""How many entries of state a key's rows make: every entry is a call of its own to the state store."""

from types import SimpleNamespace

import pandas as pd

from trailmark.streaming.in_order import SOURCE_SLOTS, Cooldown, InOrder, LastDetection, Spread


class State:
    """A value, list or map of state, which counts its entries read and written."""

    def __init__(self):
        self.rows, self.one, self.calls = {}, [], 0

    def exists(self):
        return bool(self.one)

    def get(self):
        self.calls += len(self.one)
        return self.one[0] if self.single else iter(self.one)

    def update(self, row):
        self.one, self.calls = [row], self.calls + 1

    def put(self, rows):
        self.one, self.calls = list(rows), self.calls + len(rows)

    def appendList(self, rows):
        self.one, self.calls = [*self.one, *rows], self.calls + len(rows)

    def clear(self):
        self.one, self.rows = [], {}

    def containsKey(self, key):
        self.calls += 1
        return key in self.rows

    def getValue(self, key):
        self.calls += 1
        return self.rows[key]

    def updateValue(self, key, row):
        self.calls += 1
        self.rows[key] = row


class Handle:
    def __init__(self):
        self.states = {}

    def _made(self, name, single):
        self.states[name] = State()
        self.states[name].single = single
        return self.states[name]

    def getValueState(self, name, schema, **options):
        return self._made(name, True)

    def getListState(self, name, schema, **options):
        return self._made(name, False)

    def getMapState(self, name, *schemas, **options):
        return self._made(name, False)

    def registerTimer(self, at):
        pass

    deleteTimer = registerTimer


def arrived(n):
    rows = pd.DataFrame({"seconds": range(1000, 1000 + n), "event_id": range(n), "is_row": True, "kind": "sighting"})
    return rows.assign(country="c", ip_hash=[f"ip{i}" for i in range(n)])


def test_waiting_rows_share_entries():
    for decider in (Cooldown(300, True), LastDetection(3600), Spread()):
        handle, processor = Handle(), InOrder(decider, 10**6)
        processor.init(handle)
        at = SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
        assert list(processor.handleInputRows(("k", "t"), iter([arrived(25_000)]), at)) == []
        assert handle.states["held"].calls <= 3
        # half of them are decided, the others go on waiting
        at = SimpleNamespace(getCurrentWatermarkInMs=lambda: 13_500_000)
        list(processor.handleInputRows(("k", "t"), iter([arrived(0)]), at))
        assert handle.states["held"].calls <= 8
        assert processor.place.get()[1] == 13_500


def test_sources_share_slots():
    handle, spread = Handle(), Spread()
    spread.open(handle)
    first = spread.decide(("k",), arrived(20_000))
    assert handle.states["sources"].calls <= 3 * SOURCE_SLOTS and (first["kind"] != "reupload").all()
    again = spread.decide(("k",), arrived(20_000).assign(seconds=lambda r: r["seconds"] + 7))
    uploads = again[again["kind"] == "reupload"]
    assert len(uploads) == 20_000 and set(uploads["number"]) == {2} and set(uploads["detail"]) == {7}
