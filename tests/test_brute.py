"""The queries that SQL can't express, against plain recomputations from the same tables in numpy and pandas."""

import math
import re
from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from tessella import catalog
from tessella.operators import drift as D
from tessella.plans import convergence, graphs, views
from tessella.plans.drift import shrunk
from tessella.plans.graphs import _jaro_winkler

CHECKED = [
    "agg_approx_distinct", "btx_block_bootstrap", "btx_convergence_scores", "btx_macro_backtest", "btx_macro_regimes", "cnv_clique_score", "cnv_convergence_cliques", "cnv_detect", "drf_anomaly_digest", "drf_bocpd", "drf_bocpd_changepoints", "drf_hmm_regimes", "drf_power_spectrum",
    "drf_regime_topology", "drf_scalogram", "drf_spectral_gap", "grf_probabilistic_resolution", "grf_surprise_clusters", "pfl_black_litterman", "pfl_hrp", "pfl_portfolio_weights", "pfl_robust_weights", "top_hybrid_rank",
]


@pytest.fixture(scope="module")
def run(spark, small):
    held = {}

    def f(name):
        if name not in held:
            held[name] = catalog.QUERIES[name](spark, small).toPandas()
        return held[name]

    return f


@pytest.fixture(scope="module")
def frame(spark, small):
    return lambda name: getattr(views, name)(spark, small).toPandas() if hasattr(views, name) and name != "table" else views.table(spark, small, name).toPandas()


@pytest.fixture(scope="module")
def signals(frame):
    s = frame("series")
    return {k: g.sort_values("d")["value"].to_numpy(float) for k, g in s.groupby("signal")}


def test_approximate_counts_are_near_the_exact_ones(run, frame, spark, small):
    got, o = run("agg_approx_distinct"), frame("obs")
    exact = o.groupby("source").entity_id.nunique()
    column = next(c for c in got.columns if c != "source")
    assert set(got.source) == set(exact.index)
    assert all(abs(r[column] - exact[r.source]) <= 0.1 * exact[r.source] + 2 for _, r in got.iterrows())


def maximal_cliques(edges, least):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = set()

    def grow(r, p, x):
        if not p and not x and len(r) >= least:
            out.add("|".join(sorted(r)))
        for v in list(p):
            grow(r | {v}, p & near[v], x & near[v])
            p, x = p - {v}, x | {v}

    grow(set(), set(near), set())
    return out


def of_two_categories(found, spark, small):
    category = views.series(spark, small).select("signal", "category").distinct().toPandas().set_index("signal").category
    return {c for c in found if len({category[x] for x in c.split("|")}) >= 2}


def test_cliques(run, spark, small):
    g = convergence.graph(spark, small).toPandas()
    want = of_two_categories(maximal_cliques(list(zip(g.a, g.b)), 3), spark, small)
    assert want and set(run("cnv_convergence_cliques").members) == want
    weight = {(r.a, r.b): r.weight for r in g.itertuples()}
    category = views.series(spark, small).select("signal", "category").distinct().toPandas().set_index("signal").category
    scores = run("cnv_clique_score").set_index("members").score
    for c in want:
        m = c.split("|")
        mean = sum(weight[tuple(sorted(p))] for p in combinations(m, 2)) / len(m)
        raw = mean * len({category[x] for x in m}) / len(m) * np.log2(len(m))
        assert scores[c] == pytest.approx(2 / (1 + np.exp(-raw)) - 1, abs=2e-6)


def test_the_detection_cycle(run, spark, small):
    p = convergence.combined(spark, small).toPandas().sort_values("p")
    n, rank = len(p), np.arange(1, len(p) + 1)
    adjusted = np.minimum.accumulate((p.p.to_numpy() * n / rank)[::-1])[::-1]
    kept = p[adjusted <= 0.2]
    assert len(kept) and set(run("cnv_detect").members) == of_two_categories(maximal_cliques(list(zip(kept.sa, kept.sb)), 3), spark, small)


def test_spectra(run, signals):
    got = run("drf_power_spectrum")
    for k, x in signals.items():
        p = got[got.signal == k].sort_values("frequency").power.to_numpy()
        both = 2 * p.sum() - p[0] - (p[-1] if len(x) % 2 == 0 else 0)
        assert both == pytest.approx(((x - x.mean()) ** 2).sum(), rel=1e-4, abs=1e-3)  # Parseval
    s = run("drf_scalogram")
    x = signals["flag.N"] - signals["flag.N"].mean()
    t = np.arange(-63, 64)
    wave = np.exp(2j * np.pi * t / 21 - 0.5 * (t / 21) ** 2) / np.sqrt(21)
    direct = [sum(x[i - k] * wave[k + 63] for k in range(-63, 64) if 0 <= i - k < len(x)) for i in range(len(x))]
    assert s[(s.signal == "flag.N") & (s.period == 21)].power.iloc[0] == pytest.approx(np.mean(np.abs(direct) ** 2), rel=1e-5)


def test_change_points(run, signals):
    got = run("drf_bocpd")
    assert set(got.signal) == set(signals) and (got.run_length >= 0).all()
    for k, g in got.groupby("signal"):
        g = g.sort_values("d")
        assert len(g) == len(signals[k]) and (g.run_length.to_numpy() <= np.arange(1, len(g) + 1) + 1e-6).all()
        before = g.run_length.shift(fill_value=0.0)
        sure = ((before - 10).abs() > 1e-4) & ((g.run_length - 0.5 * before).abs() > 1e-4)  # away from the rounding of the limits
        assert (g.change[sure] == ((before >= 10) & (g.run_length < 0.5 * before))[sure]).all()
    counts = run("drf_bocpd_changepoints").set_index("signal").changes
    assert counts.to_dict() == got[got.change].groupby("signal").size().to_dict()


def test_run_lengths_against_a_recursion_of_scalars():
    """The expected run length over all run lengths, each with its own sums, by Student's density from lgamma."""
    from math import exp, lgamma, log, pi, sqrt

    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 1, 30), rng.normal(6, 1, 20)])
    mean, sd2 = float(np.mean(x[:10])), float(np.std(x) + 1e-9) ** 2
    p, want = {0: 1.0}, []
    for t, v in enumerate(x):
        like = {}
        for r, q in p.items():
            mu, kappa, alpha, beta = mean, 1.0, 1.0, sd2
            for y in x[t - r : t]:
                beta += kappa * (y - mu) ** 2 / (2 * (kappa + 1))
                mu, kappa, alpha = (kappa * mu + y) / (kappa + 1), kappa + 1, alpha + 0.5
            df, scale = 2 * alpha, sqrt(beta * (kappa + 1) / (alpha * kappa))
            like[r] = q * exp(lgamma((df + 1) / 2) - lgamma(df / 2) - 0.5 * log(df * pi) - log(scale) - (df + 1) / 2 * log(1 + ((v - mu) / scale) ** 2 / df))
        p = {r + 1: q * (1 - 1 / 250) for r, q in like.items()} | {0: sum(like.values()) / 250}
        total = sum(p.values())
        p = {r: q / total for r, q in p.items()}
        want.append(sum(r * q for r, q in p.items()))
    assert np.allclose(D.run_lengths(x)[0], want, atol=1e-4)


def test_digest(run, frame):
    got, o = run("drf_anomaly_digest"), frame("obs")
    assert 0 < len(got) <= 40 and got.obs_id.is_unique and (got.z >= 1.5).all()
    assert set(got.obs_id) <= set(o.obs_id) and set(got.changed) <= {0, 1}
    daily = o.assign(day=o.ts.dt.date).groupby(["source", "day"]).value.mean()
    for source, flag in got.groupby("source").changed.first().items():
        assert flag in (0, 1) and source in daily.index.levels[0]


def test_hidden_regimes(run, frame):
    b = frame("bars").dropna(subset=["ret"])
    b["w"] = pd.to_datetime(b.d).dt.to_period("W").dt.start_time
    weekly = b.groupby(["brand", "w"]).ret.sum()
    got = run("drf_hmm_regimes").set_index("brand")
    for brand, x in weekly.groupby("brand"):
        label = D.hmm_labels(x.sort_index().to_numpy())
        assert (got.loc[brand].weeks, got.loc[brand].high, got.loc[brand].switches) == (len(x), (label == 1).sum(), (np.diff(label) != 0).sum())


def test_topology(run, frame):
    b = frame("bars").dropna(subset=["ret"])
    b["q"] = pd.to_datetime(b.d).dt.to_period("Q").dt.start_time.dt.strftime("%Y-%m-%d")
    got, gaps = run("drf_regime_topology").set_index("q"), run("drf_spectral_gap").set_index("q").gap
    base = None
    assert set(got.index) == set(b.q)
    for q, g in list(b.groupby("q"))[:6]:
        wide = g.pivot_table(index="d", columns="brand", values="ret").fillna(0.0)
        with np.errstate(all="ignore"):
            dist = np.sqrt(np.clip(2 * (1 - np.nan_to_num(np.corrcoef(wide.to_numpy().T))), 0, None))
        root, tree = list(range(len(dist))), []
        for w, i, j in sorted((dist[i, j], i, j) for i, j in combinations(range(len(dist)), 2)):  # Kruskal
            if root[i] != root[j]:
                tree.append(w)
                root = [root[i] if r == root[j] else r for r in root]
        p = np.array(tree) / max(sum(tree), 1e-12)
        assert got.loc[q].entropy == pytest.approx(-(p[p > 0] * np.log(p[p > 0])).sum(), abs=1e-5)
        assert got.loc[q].components == sum(x > np.median(tree) for x in tree) + 1
        base = tree if base is None else base
        most = max(len(tree), len(base))
        padded = [sorted(x, reverse=True) + [0.0] * (most - len(x)) for x in (tree, base)]
        assert got.loc[q].distance == pytest.approx(max(abs(x - y) for x, y in zip(*padded)), abs=2e-6)
        near = (dist < np.median(dist[~np.eye(len(dist), dtype=bool)])) & ~np.eye(len(dist), dtype=bool)
        assert gaps[q] == pytest.approx(np.sort(np.linalg.eigvalsh(np.diag(near.sum(1)) - near))[1], abs=2e-3)


def test_portfolios(run, spark, small):
    c = shrunk(spark, small).toPandas()
    names = sorted(set(c.a))
    for name in ("pfl_black_litterman", "pfl_hrp", "pfl_robust_weights", "pfl_portfolio_weights"):
        got = run(name)
        assert sorted(got.brand) == names and (got.weight >= -1e-9).all()
        assert np.allclose(got.groupby(got.brand.str[:7]).weight.sum(), 1, atol=1e-4)
    robust = run("pfl_robust_weights").set_index("brand").weight
    for maker in {n[:7] for n in names}:
        own = [n for n in names if n.startswith(maker)]
        m = c[c.a.isin(own) & c.b.isin(own)].pivot_table(index="a", columns="b", values="c").fillna(0.0).loc[own, own].to_numpy()
        m = m + 0.1 * np.trace(m) / len(own) * np.eye(len(own))
        w = robust[own].to_numpy()
        rng = np.random.default_rng(1)
        for v in [np.full(len(own), 1 / len(own)), *rng.dirichlet(np.ones(len(own)), 200)]:
            assert w @ m @ w <= v @ m @ v * 1.02  # no portfolio has clearly less variance


def test_bootstrap(run):
    got = run("btx_block_bootstrap")
    low, high = (next(c for c in got.columns if c.lower().startswith(p)) for p in ("lo", "hi"))
    assert len(got) and (got[low] <= got[high]).all()


def test_probabilistic_resolution(run, frame, spark, small):
    levels = graphs.grf_similarity_levels(spark, small).toPandas()
    part = views.table(spark, small, "part").toPandas().set_index("p_partkey").p_name
    s = [_jaro_winkler(part[a], part[b]) for a, b in zip(levels.a, levels.b)]
    assert [2 if x >= 0.95 else 1 if x >= 0.88 else 0 for x in s] == levels.level.tolist()
    share = levels.level.value_counts() / len(levels)
    prior = {2: 0.85, 1: 0.10, 0: 0.05}
    odds = levels.level.map(lambda x: prior[x] / share[x]) * 0.05 / 0.95
    p = (odds / (1 + odds)).round(6)
    want = {(a, b): x for a, b, x in zip(levels.a, levels.b, p) if x >= 0.05}
    got = {(r.a, r.b): r.p for r in run("grf_probabilistic_resolution").itertuples()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_surprise_clusters(run, frame):
    o, k = frame("obs"), frame("links")
    v = o.pivot_table(index="entity_id", columns="source", values="value", aggfunc="mean").reindex(columns=["click", "view", "purchase", "error", "signup"]).fillna(0.0)
    v = v[v.max(axis=1) >= 60]
    k = k[(k.link_type == "headquartered_in") & k.entity_a.isin(v.index)]
    want = []
    for _, g in k.groupby("entity_b"):  # entities of one country are one component
        x = v.loc[g.entity_a].to_numpy()
        if len(x) >= 2:
            m = x.mean(0)
            want.append((len(x), float(np.mean(x @ m / (np.linalg.norm(x, axis=1) * np.linalg.norm(m))))))
    got = sorted((r.members, r.coherence) for r in run("grf_surprise_clusters").itertuples())
    assert len(got) == len(want) and np.allclose(got, sorted(want), atol=2e-6)


def test_hybrid_rank(run, spark, small):
    p = graphs.pagerank(spark, small).toPandas().set_index("node").p
    names = views.entities(spark, small).toPandas().set_index("entity_id").name
    score = pd.Series({e: 0.7 * _jaro_winkler(names[e].lower(), "brand#12") + 0.3 * x / p.max() for e, x in p.items() if e in names})
    got = run("top_hybrid_rank").set_index("entity_id").score
    assert len(got) == 25 and got.iloc[0] == pytest.approx(score.max(), abs=2e-6)
    assert got.min() >= score.nlargest(25).min() - 2e-6 and all(abs(score[e] - x) < 2e-6 for e, x in got.items())


def binomial_tail(k, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1)) if k > 0 else 1.0


def fresh_detection(values, category, q, templates):
    """One detection on the lookback's weeks alone: (score, direction, cliques, match). values: signal to its last 52 weekly values."""
    tests = {}
    for a, b in combinations(sorted(values), 2):
        x, y = values[a], values[b]
        corr = []
        for i in range(12, 53):
            u, v = x[i - 12 : i], y[i - 12 : i]
            corr.append(np.corrcoef(u, v)[0, 1] if u.std() > 1e-12 and v.std() > 1e-12 else np.nan)
        old = np.array([c for c in corr[:-1] if not np.isnan(c)])
        if np.isnan(corr[-1]) or len(old) < 2 or old.std(ddof=1) == 0:
            continue
        z = (corr[-1] - old.mean()) / old.std(ddof=1)
        far = [np.abs((s - s.mean()) / s.std(ddof=1)) > 1 if s.std(ddof=1) > 0 else np.zeros(52, bool) for s in (x, y)]
        k = int((np.sign(np.diff(x)) == np.sign(np.diff(y))).sum())
        p1 = math.erfc(abs(z) / math.sqrt(2))
        p2 = min(1.0, binomial_tail(int((far[0] & far[1]).sum()), 52, far[0].mean() * far[1].mean()))
        p3 = min(1.0, 2 * min(binomial_tail(k, 51, 0.5), binomial_tail(51 - k, 51, 0.5)))
        h = -sum(math.log(max(p, 1e-300)) for p in (p1, p2, p3))
        tests[a, b] = (math.exp(-h) * (1 + h + h * h / 2), abs(z), 1 if k / 51 >= 0.5 else -1)
    order = sorted(tests, key=lambda e: tests[e][0])
    adjusted, least = {}, 1.0
    for i in range(len(order), 0, -1):
        least = min(least, tests[order[i - 1]][0] * len(order) / i)
        adjusted[order[i - 1]] = least
    edges = {e: tests[e] for e in order if adjusted[e] <= q}
    found = [c.split("|") for c in maximal_cliques(list(edges), 2)]
    out = []
    for c in found:
        if len({category[s] for s in c}) >= 2:
            inside = [edges[e] for e in combinations(sorted(c), 2)]
            raw = sum(w for _, w, _ in inside) / len(c) * len({category[s] for s in c}) / len(c) * math.log2(len(c))
            side = {s: np.sign(values[s][-1] - values[s].mean()) for s in c}
            match = max(np.mean([any(category[s] == cat and re.search(pattern, s) and sign in (0, side[s]) for s in c) for t, _, cat, pattern, sign, _ in templates if t == name]) for name in {t[0] for t in templates})
            score = round(2 / (1 + math.exp(-raw)) - 1, 6)
            out.append((min(1.0, score * (1 + 0.5 * match)), "|".join(sorted(c)), int(np.sign(sum(w * s for _, w, s in inside))), match))
    best = max(out) if out else (0.0, "", 0, 0.0)
    return best[0], best[2], len(out), best[3]


def test_each_step_of_the_sweep_is_a_fresh_detection(run, frame):
    got = run("btx_convergence_scores").sort_values("w").reset_index(drop=True)
    s = frame("series")
    s["w"] = pd.to_datetime(s.d).dt.to_period("W-SUN").dt.start_time
    category = s.groupby("signal").category.first()
    grid = {}
    for k, g in s.groupby("signal"):
        v = g.groupby("w").value.sum().round(6)
        grid[k] = v.reindex(pd.date_range(v.index.min(), v.index.max(), freq="7D")).ffill()
    weeks = sorted({w for v in grid.values() for w in v.index})
    assert list(got.w) == [str(w.date()) for w in weeks]
    hits = got.index[got.n_cliques > 0]
    assert len(hits)
    for i in [*hits[:: max(1, len(hits) // 6)], *range(40, len(weeks), 90)]:
        w = weeks[i]
        seen = {k: v.loc[:w].to_numpy()[-52:] for k, v in grid.items() if w in v.index and len(v.loc[:w]) >= 52}
        score, direction, n, match = fresh_detection(seen, category, 0.2, convergence.TEMPLATES)
        r = got.loc[i]
        assert (r.n_cliques, r.direction) == (n, direction), w
        assert r.score == pytest.approx(score, abs=2e-5) and r.template_match == pytest.approx(match, abs=1e-6)


def test_macro_backtest(run, frame):
    scores = run("btx_convergence_scores").set_index("w")
    got = run("btx_macro_backtest").set_index(["target", "strategy"])
    regimes = run("btx_macro_regimes").set_index(["target", "strategy", "regime"])
    b = frame("bars")
    b["w"] = pd.to_datetime(b.d).dt.to_period("W-SUN").dt.start_time
    for target, g in b.groupby("brand"):
        close = g.sort_values("d").groupby("w").close.last()
        ret = np.log(close / close.shift()).dropna()
        n = (len(ret) - 52) // 12 * 12
        test = ret.iloc[52 : 52 + n]
        at = scores.reindex([str(w.date()) for w in test.index]).fillna(0)
        stress, sc, m = (at.direction >= 1).to_numpy(), at.score.to_numpy(), at.template_match.to_numpy()
        weights = {"convergence_risk_off": np.where(stress & (sc > 0.3), 0, 1), "convergence_directional": np.where(stress, 1 - np.minimum(sc, 1), 1), "convergence_template": np.where(stress & (sc > 0.3) & (m > 0.5), 0, 1), "buy_and_hold": np.ones(n)}
        sharpe = {k: (lambda r: r.mean() / r.std() * math.sqrt(52) if r.std() else 0.0)(w * test.to_numpy()) for k, w in weights.items()}
        for k, w in weights.items():
            r = got.loc[(target, k)]
            assert r.weeks == n and r.folds == n // 12
            assert r.total == pytest.approx((w * test).sum(), abs=2e-5) and r.sharpe == pytest.approx(sharpe[k], abs=2e-4)
            assert r.sharpe_diff == pytest.approx(sharpe[k] - sharpe["buy_and_hold"], abs=3e-4)
            assert r.ci_lo <= r.ci_hi and r.ci_lo - 1 <= r.sharpe <= r.ci_hi + 1
            name = np.where(at.direction >= 1, "stress", np.where(at.direction <= -1, "relief", "quiet"))
            for q in set(name):
                x = regimes.loc[(target, k, q)]
                assert x.weeks == (name == q).sum() and x["mean"] == pytest.approx((w * test.to_numpy())[name == q].mean(), abs=2e-6)
