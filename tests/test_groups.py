"""Units that share a representation are read as one row with counts."""
import pickle

import numpy as np
import pytest

from attraudit.operators import ranking
from attraudit.operators.erasure import erasure_effect, erasure_effects, nullspace_directions
from attraudit.operators.network import Network, fit_network, network_group_scores, score_network
from attraudit.operators.probes import BASELINE, FourierMap, ProbeTable, Variant
from attraudit.plans import external, representation as plans
from attraudit.plans.inputs import Study

VECTORS, UNITS = 40, 900


@pytest.fixture(scope="module")
def tables(spark):
    """Many units on few vectors, with gaps in labels and designs."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(VECTORS, 3)) * [1, 2, 3] + 5
    rows, emb = [], []
    for i in range(UNITS):
        v = int(rng.integers(VECTORS))
        a = int(rng.random() < 1 / (1 + np.exp(-(x[v, 0] - 5))))
        y = int(rng.random() < 0.3 + 0.4 * a)
        rows.append((i, i, ("train", "train", "val", "test")[i % 4], None if i % 17 == 0 else a, None if i % 13 == 0 else y))
        emb.append(("m", i, [float(w) for w in x[v]]))
    units = spark.createDataFrame(rows, "unit_id int, entity_id int, split string, a int, y int")
    return spark.createDataFrame(emb, "model string, unit_id int, embedding array<double>"), units


def test_scans_read_a_vector_once_and_keep_every_unit(tables):
    with ProbeTable(*tables, ["a"], ["a", "y"]) as t:
        got = t.groups.selectExpr("count(1) AS g", "sum(y[0]) AS n", "sum(y[2]) AS known", "sum(y[4]) AS hits").first()
        true = t.rows.selectExpr("count(1)", "count(y[1])", "sum(y[1])").first()
    assert got["g"] <= VECTORS * 3 * 3 and (got["n"], got["known"], got["hits"]) == tuple(true)


@pytest.mark.parametrize("balanced", [False, True])
def test_fit_and_scores_of_groups_equal_those_of_single_units(tables, balanced):
    emb, units = tables
    cells = [Variant("removed", remove=("a",)), Variant("kept", cohort=("a",)), BASELINE]
    with ProbeTable(emb, units, ["a"], ["y"]) as t:
        grouped = t.fit(t.cells(cells, ["y"]), balanced=balanced)
        a = {(r["variant"], r["n"], r["n_pos"]): r["auroc"] for r in ranking.auroc(t.group_scores(grouped), ["model", "variant"], weight="w").collect()}
        b = {(r["variant"], r["n"], r["n_pos"]): r["auroc"] for r in ranking.auroc(t.score(grouped), ["model", "variant"]).collect()}
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=0.02) for k in a)
        # every unit as a row of its own: `f` tells them apart, and no cell looks at it
    apart = units.withColumn("own", units.unit_id.cast("double"))
    with ProbeTable(emb, apart, ["a", "own"], ["y"]) as t:
        single = t.fit(t.cells(cells, ["y"]), balanced=balanced)
        assert t.groups.count() == UNITS
    for u, v in zip(grouped.coef, single.coef):
        np.testing.assert_allclose(u[:4], v[:4], atol=1e-4)
        assert u[-1] == pytest.approx(v[-1], abs=1e-4)


def test_network_scores_of_groups(tables):
    with ProbeTable(*tables, [], ["y"]) as t:
        fitted = fit_network(t, t.cells([BASELINE], ["y"]), Network(hidden=4, max_rounds=5))
        a = ranking.auroc(network_group_scores(t, fitted), ["model"], weight="w").first()
        b = ranking.auroc(score_network(t, fitted), ["model"]).first()
    assert (a["n"], a["n_pos"]) == (b["n"], b["n_pos"]) and a["auroc"] == pytest.approx(b["auroc"], abs=0.02)


def test_what_tasks_unpickle_needs_no_package(tables):
    with ProbeTable(*tables, ["a"], ["y"]) as t:
        u = t.mapped(FourierMap(20), Variant("removed", remove=("a",), alpha=0.0))
        assert b"attraudit" not in pickle.dumps(u._fourier)
        u.fit(u.cells([BASELINE], ["y"]))


def test_effects_of_all_attributes_at_once_equal_one_by_one(tables):
    emb, units = tables
    with ProbeTable(emb, units, [], ["a", "y"]) as t:
        ends = {}
        found, _ = nullspace_directions(t, ["a", "y"], max_rounds=2, target=0.55, ends=ends)
        every = {r["attribute"]: r.asDict() for r in erasure_effects(t, found, ["y"], ends=ends).collect()}
        for k in found:
            one = erasure_effect(t, k, found[k], ["y"]).first().asDict()
            assert {c: every[k][c] for c in ("model", "n_dirs")} == {c: one[c] for c in ("model", "n_dirs")}
            for c in ("decode_after", "drop_concept", "drop_random", "net_drop"):
                assert every[k][c] == pytest.approx(one[c], abs=0.01), (k, c)


def test_search_leaves_no_second_fit_where_nothing_was_found(tables, monkeypatch):
    emb, units = tables
    fitted = []
    fit = ProbeTable.fit
    monkeypatch.setattr(ProbeTable, "fit", lambda self, cells, **k: (fitted.extend((c.variant.name, c.target) for c in cells), fit(self, cells, **k))[1])
    plans.erasure_study(Study(emb, units, ["a"], ["y"], min_train=5, min_test=5, min_pos=1), ["a"], max_rounds=0).collect()
    assert sorted(fitted) == [("baseline", "y"), ("erase:a", "a")]


def test_external_extended_reads_one_table_and_fits_each_probe_once(tables, monkeypatch):
    emb, units = tables
    made, fitted, map_ = [], [], FourierMap(20)
    init, fit = ProbeTable.__init__, ProbeTable.fit
    monkeypatch.setattr(ProbeTable, "__init__", lambda self, *a, **k: (made.append(self), init(self, *a, **k))[1])
    monkeypatch.setattr(ProbeTable, "fit", lambda self, cells, **k: (fitted.extend((self.map is None, c.variant.name, c.target) for c in cells if c.variant == BASELINE), fit(self, cells, **k))[1])
    s = Study(emb, units.selectExpr("*", "(unit_id div 4) % 2 AS grp"), ["a"], ["y"], min_train=5, min_test=5, min_pos=1)
    out = external.external_extended(s, ["a"], "grp", map_, b=60, max_rounds=2)
    got = {r["space"]: r.asDict() for r in out["erasure"].collect()}
    assert out["summary"].count() == 6 and out["auroc_gap"].count() == 1
    assert len(made) == 1 and sorted(fitted) == [(False, "baseline", "y"), (True, "baseline", "y")]
    for space, m in (("raw", None), ("rff", map_)):
        one = plans.erasure_study(s, ["a"], m, max_rounds=2).first().asDict()
        assert set(one) == set(got[space])
        for k, v in one.items():
            assert got[space][k] == (pytest.approx(v, abs=1e-6) if isinstance(v, float) else v), (space, k)


def test_scaler_counts_every_unit_of_a_group(tables):
    emb, units = tables
    with ProbeTable(emb, units, ["a"], ["y"]) as t:
        true = t.train.selectExpr("avg(x[1]) AS m", "stddev_pop(x[1]) AS s", "avg(f[0]) AS f").first()
        (mu, sd), middle = t._scale["m"], t._middle["m"]
    assert (mu[1], sd[1], middle[0]) == pytest.approx(tuple(true), abs=1e-12)
