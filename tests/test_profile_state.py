"""The values a source has shown travel to its state by bucket."""

from __future__ import annotations

import pandas as pd

from tidewatch.streaming import state


class Held:
    """State of one key, and how often it was asked or told."""

    def __init__(self):
        self.rows, self.trips = {}, 0

    def getValueState(self, name, schema):
        return self

    getMapState = lambda self, name, key, value: self

    def exists(self):
        return None in self.rows

    def get(self):
        return self.rows[None]

    def update(self, value):
        self.rows[None] = value

    def containsKey(self, key):
        self.trips += 1
        return key in self.rows

    def getValue(self, key):
        self.trips += 1
        return self.rows[key]

    def updateValue(self, key, value):
        self.trips += 1
        self.rows[key] = value


def test_a_batch_asks_the_state_by_bucket_and_counts_values_once():
    def batch(numbers):
        n = pd.Series(list(numbers))
        return pd.DataFrame({"no": n, "protocol": 6, "bytes_sent": 1, "bytes_recv": 1, "packets_sent": 1, "packets_recv": 1, "dst_port": n % 700,
                             "src_port": n * 7 % 900, "dst_ip": [f"10.0.0.{x % 5}" if x % 11 else "" for x in n], "seen_s": n * 60.0})

    held = Held()
    p = state._Profiles(["no"], ["no", *state.DISTINCT])
    p.init(held)
    rows = pd.concat([next(iter(p.handleInputRows(("s",), iter([batch(r)]), None))) for r in (range(1000), range(600, 2500))])
    assert held.trips <= 2 * 3 * len(state.DISTINCT) * state.BUCKETS
    seen = {n: set() for n in state.DISTINCT}
    for got, x in zip(rows.itertuples(), [*range(1000), *range(600, 2500)]):
        seen["unique_dst_ports"] |= {x % 700} - {0}
        seen["unique_src_ports"] |= {x * 7 % 900} - {0}
        seen["unique_dst_ips"] |= {x % 5} if x % 11 else set()
        seen["active_hours"] |= {x // 60 % 24}
        assert {n: getattr(got, n) for n in seen} == {n: len(v) for n, v in seen.items()}
