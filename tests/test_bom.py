"""Dependent demand through all levels, low-level codes, cycles."""
import random

import pytest

from replenish.operators.bom import CyclicBom, multilevel_demand
from replenish.operators.position import DEMAND_COLS, apply_bom

BASE = "sku string, " + ", ".join(f"{c} double" for c in DEMAND_COLS)
BOM = "parent_sku string, component_sku string, component_name string, qty_required double"


def tables(spark, own, recipes):
    base = spark.createDataFrame([(s, *[v * (i + 1) for i in range(len(DEMAND_COLS))]) for s, v in own], BASE)
    return base, spark.createDataFrame([(p, x, "n", q) for p, x, q in recipes], BOM)


def test_random_recipes_against_recursion(spark):
    rng = random.Random(8)
    recipes = [(f"s{a:02}", f"s{b:02}", float(rng.randrange(1, 4))) for a in range(30) for b in range(a + 1, 30) if rng.random() < 0.12]
    recipes += [recipes[0], ("absent", "s29", 2.0), (None, "s03", 1.0), ("s04", None, 1.0)]
    own = [(f"s{a:02}", float(rng.randrange(5))) for a in range(30) for _ in range(2)]
    mine = {}
    for s, v in own:
        mine[s] = mine.get(s, 0.0) + v
    rows = [(p, x, q) for p, x, q in recipes if p and x]
    parts = {x for _, x, _ in rows}

    def demand(s):
        return sum(q * demand(p) for p, x, q in rows if x == s) if s in parts else mine.get(s, 0.0)

    def code(s):
        return 1 + max(code(p) for p, x, _ in rows if x == s) if s in parts else 0

    got = multilevel_demand(*tables(spark, own, recipes)).collect()
    assert {r.sku for r in got} == parts and len(got) == len(parts)
    for r in got:
        assert r.low_level_code == code(r.sku)
        assert [r[f"dep_{c}"] for c in DEMAND_COLS] == pytest.approx([demand(r.sku) * (i + 1) for i in range(len(DEMAND_COLS))])


def test_all_levels_replace_a_components_own_demand(spark):
    base, bom = tables(spark, [("car", 2.0), ("wheel", 50.0), ("bolt", 7.0), ("cup", 3.0)], [("car", "wheel", 4.0), ("wheel", "bolt", 5.0)])
    got = {r.sku: (r[DEMAND_COLS[0]], r.is_component) for r in apply_bom(base, bom, levels=0).collect()}
    assert got == {"car": (2.0, False), "wheel": (8.0, True), "bolt": (40.0, True), "cup": (3.0, False)}
    same = lambda n: sorted(map(str, apply_bom(base, bom, levels=n).collect()))
    assert same(0) == same(2) != same(1)


@pytest.mark.parametrize("recipes", [[("a", "a", 1.0)], [("a", "b", 1.0), ("b", "c", 1.0), ("c", "b", 2.0)], [("b", "c", 1.0), ("c", "b", 1.0)]])
def test_a_cycle_raises(spark, recipes):
    with pytest.raises(CyclicBom, match="[abc]"):
        multilevel_demand(*tables(spark, [("a", 1.0)], recipes))


def test_no_recipes(spark):
    assert multilevel_demand(*tables(spark, [("a", 1.0)], [])).collect() == []
