"""Registered queries take the whole of their stand-in tables: brute force on tables larger than the old id ranges."""

import duckdb

from plumbline.plans.queries import QUERIES

SF = "/root/testdata/sf0.01"  # 2000 parts


def _parts():
    return duckdb.sql(f"SELECT p_partkey, p_size, p_brand, p_name FROM '{SF}/part.parquet'").fetchall()


def test_symbol_tables_take_all_parts(spark):
    want = {}
    for key, _, brand, name in _parts():
        want.setdefault((brand, name.split(" ")[0]), []).append(key)
    got = {(r["class"], r.method): (r.method_id, r.candidates) for r in QUERIES["c05_symbol_tables"](spark, SF).collect()}
    assert got == {k: (min(v), len(v)) for k, v in want.items()}
    assert sum(n for _, n in got.values()) == len(_parts())


def test_inherited_methods_take_all_parts(spark):
    parts = _parts()
    own = {key: {f"m{size % 8}": key} for key, size, _, _ in parts if size % 4 == 0}
    want = {}
    for key, _, _, _ in parts:
        at, depth = key, 0
        while depth <= 4 and (at > 0 or depth == 0):
            for name, method in own.get(at, {}).items():
                want.setdefault((key, name), method)
            at, depth = at // 2, depth + 1
    got = {(r["class"], r.name): r.method_id for r in QUERIES["c07_inherited_methods"](spark, SF).collect()}
    assert got == want


def test_same_shape_takes_all_projects_and_versions(spark, sf_dir):
    want = {(p, v) for (p,) in duckdb.sql(f"SELECT DISTINCT o_custkey FROM '{sf_dir}/orders.parquet'").fetchall() for v in (1, 2)}
    assert {(r.project, r.version) for r in QUERIES["c16_same_shape"](spark, sf_dir).collect()} == want and len(want) > 10
