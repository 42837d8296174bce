"""Queries over values that want one token: each has a token of its own, and what stands in a text leads back to the text's own value."""

from __future__ import annotations

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from sievemark.functions import masking as M
from sievemark.plans import mapping_queries, request_queries
from sievemark.plans.detector_queries import KEY

SMALL = "/root/testdata/sf0.001"


def _pair(label: str, value, keys, fits=lambda a, b: True) -> tuple[int, int]:
    """Two keys whose values want one token."""
    seen: dict[str, int] = {}
    for k in keys:
        other = seen.setdefault(M.token_of(KEY, label, value(k)), k)
        if other != k and fits(value(other), value(k)):
            return other, k
    raise AssertionError("no pair")


@pytest.fixture
def tables(tmp_path):
    def made(**rows):
        for name in os.listdir(SMALL):
            table = name.removesuffix(".parquet")
            if table in rows:
                own = pq.read_table(f"{SMALL}/{name}")
                pq.write_table(pa.table({c: rows[table].get(c, own[c].to_pylist()[: len(next(iter(rows[table].values())))]) for c in own.column_names}, schema=own.schema), tmp_path / name)
            else:
                os.symlink(f"{SMALL}/{name}", tmp_path / name)
        return str(tmp_path)

    return made


def _mail(k: int) -> str:
    return f"c{k}@mail1.example.com"


def test_texts_are_masked_and_restored_by_one_mapping(spark, tables):
    keys = _pair("EMAIL", _mail, range(1, 200_000), lambda a, b: len(a) % 2 != len(b) % 2)
    sf = tables(customer={"c_custkey": list(keys), "c_nationkey": [1, 1]})
    counts = {r.sid: (r.restored, r.unresolved) for r in request_queries.restore_log(spark, sf).where("sid LIKE 'cust:%'").collect()}
    assert counts == {f"cust:{k}": ((0, 2) if len(_mail(k)) % 2 else (1, 1)) for k in keys}
    values = mapping_queries.token_values(spark, sf).where("row_id LIKE 'cust:%' AND value LIKE 'c%'").collect()
    assert {(r.row_id, r.value) for r in values} == {(f"cust:{k}", _mail(k)) for k in keys}


def test_names_that_share_a_token_stay_apart(spark, tables):
    keys = _pair("NAME", lambda k: f"customer {k}", range(8, 800_000, 8))
    got = mapping_queries.nested_values(spark, tables(customer={"c_custkey": sorted({*keys, *(k + 1 for k in keys)})})).collect()
    assert len(got) == len({r.token for r in got}) == 4
    assert sorted(r.value for r in got) == sorted(f"customer {k}" for k in keys for _ in range(2))


def test_uses_of_values_that_share_a_token_stay_apart(spark, tables):
    users = _pair("EMAIL", lambda k: f"u{k}@mail.example.com", range(200_000))
    got = mapping_queries.upserted(spark, tables(events={"user_id": list(users) * 6})).collect()
    assert sorted(r.value for r in got) == sorted(f"u{k}@mail.example.com" for k in users) and len({r.token for r in got}) == 2
