"""Knowledge maps: prerequisite graphs, beliefs about what a learner knows, and what to ask next.

A graph has tens of nodes and lives in a plain object that travels with the task; the sessions of
learners are the rows, so work is parallel over sessions.
"""

from __future__ import annotations

import copy
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.operators.metrics import entropy

FAMILIARITY = {"none": 0.05, "heard_of": 0.40, "basic": 0.70, "solid": 0.85, "deep": 0.95}
UNKNOWN, KNOWS_IF_READY, KNOWS_ANYWAY, CUT = 0.3, 0.90, 0.05, 0.5
OVERCLAIM, UNDERCLAIM = 0.15, 0.05


class Graph:
    """Nodes as dicts with id, title and optional level, obscurity, prerequisites; repeated ids and cycles are errors."""

    def __init__(self, nodes: list[dict]):
        self.nodes = {n["id"]: n for n in nodes}
        if len(self.nodes) != len(nodes):
            raise ValueError("node ids repeat")
        self.before = {i: list(n.get("prerequisites") or []) for i, n in self.nodes.items()}
        self.after: dict[str, list[str]] = {i: [] for i in self.nodes}
        for i, needs in self.before.items():
            for p in needs:
                if p in self.after:
                    self.after[p].append(i)
        loop = find_cycle(self.before)
        if loop:
            raise ValueError(f"prerequisites form a cycle: {' -> '.join(loop)}")

    def prior(self, node: str) -> float:
        n = self.nodes.get(node, {})
        level = n.get("obscurity")
        return max(0.05, 0.5 - 0.08 * (3 if level is None else level))

    def order(self) -> list[str]:
        """Prerequisites first; ids that only occur as prerequisites are listed too."""
        out: list[str] = []
        seen: set[str] = set()
        for root in self.nodes:
            stack = [(root, iter(self.before[root]))] if root not in seen else []
            seen.add(root)
            while stack:
                node, rest = stack[-1]
                nxt = next((p for p in rest if p not in seen), None)
                if nxt is None:
                    out.append(node)
                    stack.pop()
                else:
                    seen.add(nxt)
                    stack.append((nxt, iter(self.before.get(nxt, []))))
        return out


def find_cycle(before: dict[str, list[str]]) -> list[str]:
    """Ids along one cycle, in the order walked; empty if there is none."""
    state: dict[str, int] = {}
    for root in before:
        path, stack = [], [(root, iter(before[root]))] if not state.get(root) else []
        if stack:
            state[root] = 1
            path.append(root)
        while stack:
            node, rest = stack[-1]
            for p in rest:
                if p not in before:
                    continue
                if state.get(p) == 1:
                    return [*path[path.index(p) :], p]
                if not state.get(p):
                    state[p] = 1
                    path.append(p)
                    stack.append((p, iter(before[p])))
                    break
            else:
                state[node] = 2
                path.pop()
                stack.pop()
    return []


def without_cycles(nodes: list[dict]) -> list[dict]:
    """nodes with defaults filled in, unknown and own prerequisites dropped, and cycles cut at the last prerequisite of the node that closes them."""
    ids = {n["id"] for n in nodes}
    out = [{"level": 2, "obscurity": 3, **n, "prerequisites": [p for p in n.get("prerequisites") or [] if p in ids and p != n["id"]]} for n in nodes]
    by = {n["id"]: n for n in out}
    while loop := find_cycle({i: n["prerequisites"] for i, n in by.items()}):
        by[loop[0]]["prerequisites"].pop()
    return out


@dataclass(frozen=True)
class Network:
    """ready: chance to know a node whose prerequisites are known; anyway: otherwise; cut: belief from which an answer counts as knowing."""

    ready: float = KNOWS_IF_READY
    anyway: float = KNOWS_ANYWAY
    cut: float = CUT


@dataclass
class Beliefs:
    p: dict[str, float]
    assessed: set[str] = field(default_factory=set)
    history: list[dict] = field(default_factory=list)
    bayesian: bool = False
    network: Network = Network()


def start(graph: Graph, prior: Callable[[dict], float] | None = None, bayesian: bool = False, network: Network = Network()) -> Beliefs:
    return Beliefs({i: prior(n) if prior else graph.prior(i) for i, n in graph.nodes.items()}, bayesian=bayesian, network=network)


def bayesian_sweep(graph: Graph, b: Beliefs) -> None:
    """One pass down and one up over a noisy-and network; assessed nodes are evidence and stay as they are."""
    net = b.network
    evidence = {i: b.p[i] >= net.cut for i in b.assessed if i in b.p}
    if not evidence:
        return
    order = graph.order()
    pi: dict[str, float] = {}
    for i in order:
        needs = graph.before.get(i, [])
        if i in evidence:
            pi[i] = float(evidence[i])
        elif not needs:
            pi[i] = graph.prior(i)
        else:
            ready = 1.0
            for q in needs:
                ready *= pi.get(q, UNKNOWN)
            pi[i] = net.ready * ready + net.anyway * (1 - ready)
    yes, no = dict.fromkeys(order, 1.0), dict.fromkeys(order, 1.0)
    for i in reversed(order):
        needs = graph.before.get(i, [])
        if i in evidence:
            l1, l0 = (1.0, 0.0) if evidence[i] else (0.0, 1.0)
        else:
            l1, l0 = yes[i], no[i]
        for q in needs:
            others = 1.0
            for r in needs:
                if r != q:
                    others *= float(evidence[r]) if r in evidence else pi.get(r, UNKNOWN)
            ready = net.ready * others + net.anyway * (1 - others)
            if q in yes:
                yes[q] *= ready * l1 + (1 - ready) * l0
                no[q] *= net.anyway * l1 + (1 - net.anyway) * l0
    for i in order:
        if i in b.assessed:
            continue
        a, c = pi[i] * yes[i], (1 - pi[i]) * no[i]
        if a + c > 0:
            b.p[i] = min(0.99, max(0.01, a / (a + c)))


@dataclass(frozen=True)
class Heuristic:
    """down: cap of descendants; floors: of ancestors of a basic and of a better answer; fade: loss a step; sweeps over prerequisites; ready: whether an own pass raises nodes whose prerequisites are met."""

    down: float = 0.1
    basic_floor: float = 0.65
    floor: float = 0.8
    fade: float = 0.8
    sweeps: int = 3
    ready: bool = False


def heuristic_spread(graph: Graph, b: Beliefs, node: str | None, familiarity: str | None, h: Heuristic = Heuristic()) -> None:
    """Spread one answer: down from a weak one, up from a strong one, then sweeps over all nodes."""

    def walk(i: str, depth: int, seen: set[str], links: dict[str, list[str]], change) -> None:
        for j in links.get(i, []):
            if j in seen:
                continue
            seen.add(j)
            if j not in b.assessed and j in b.p:
                b.p[j] = change(b.p[j], depth)
            walk(j, depth + 1, seen, links, change)

    if node is not None and familiarity in ("none", "heard_of"):
        walk(node, 1, {node}, graph.after, lambda p, d: min(p, h.down * h.fade**d))
    elif node is not None and familiarity in ("basic", "solid", "deep"):
        low = h.basic_floor if familiarity == "basic" else h.floor
        walk(node, 1, {node}, graph.before, lambda p, d: max(p, 1 - (1 - low) * h.fade**d))
    for _ in range(h.sweeps):
        moved = False
        for i in graph.nodes:
            needs = graph.before[i]
            if i in b.assessed or not needs:
                continue
            least = min(b.p.get(q, UNKNOWN) for q in needs)
            old = b.p[i]
            if least >= 0.5:
                b.p[i] = max(old, 0.5 + 0.35 * (least - 0.5) / 0.5)
            elif least < 0.2:
                b.p[i] = min(old, 0.15 + 0.35 * least / 0.2)
            moved |= abs(b.p[i] - old) > 1e-9
        if not moved:
            break
    if h.ready:
        for i in graph.nodes:
            needs = graph.before[i]
            if needs and i not in b.assessed and all(b.p.get(q, UNKNOWN) >= 0.7 for q in needs):
                b.p[i] = max(b.p[i], 0.5)


def spread(graph: Graph, b: Beliefs, node: str | None, familiarity: str | None, h: Heuristic = Heuristic()) -> None:
    if b.bayesian:
        bayesian_sweep(graph, b)
    else:
        heuristic_spread(graph, b, node, familiarity, h)


def answer(graph: Graph, b: Beliefs, node: str, familiarity: str, noisy: bool = False, overclaim: float = OVERCLAIM, underclaim: float = UNDERCLAIM, h: Heuristic = Heuristic()) -> Beliefs:
    """b after an answer, changed in place: the level's probability, or with noisy a Bayes step that allows for over- and underclaiming."""
    if familiarity not in FAMILIARITY:
        raise ValueError(f"unknown familiarity: {familiarity}")
    p = b.p.get(node, UNKNOWN)
    if noisy:
        claims = familiarity in ("basic", "solid", "deep")
        right, wrong = (1 - underclaim, overclaim) if claims else (underclaim, 1 - overclaim)
        total = p * right + (1 - p) * wrong
        new = p * right / total if total > 0 else p
    else:
        new = FAMILIARITY[familiarity]
    b.p[node] = new
    b.assessed.add(node)
    b.history.append({"node": node, "familiarity": familiarity, "before": p, "after": new})
    spread(graph, b, node, familiarity, h)
    return b


def total_entropy(b: Beliefs) -> float:
    from math import log2

    return sum(-(p * log2(p) + (1 - p) * log2(1 - p)) for p in b.p.values() if 0 < p < 1)


def _candidates(graph: Graph, b: Beliefs) -> list[str]:
    return [i for i in graph.nodes if i not in b.assessed and 0.05 <= b.p.get(i, UNKNOWN) <= 0.85]


def question_type(asked: int, candidates: int, p: float) -> str:
    if asked < 3:
        return "recognition"
    if asked % 4 == 0 and candidates >= 2:
        return "comparison"
    return "scoping" if p > 0.6 else "recognition"


def next_probe(graph: Graph, b: Beliefs, strategy: str = "eig", simulate_with_state: bool = False) -> dict | None:
    """The node to ask about: largest expected entropy drop ("eig") or the most uncertain one ("entropy"); None when none is open.

    Answers are simulated five times a candidate, weighted by closeness to the belief; the first of
    equal candidates wins. Simulation spreads by the heuristic, unless simulate_with_state.
    """
    open_ = _candidates(graph, b)
    if not open_:
        return None
    single = lambda i: total_entropy(Beliefs({i: b.p.get(i, UNKNOWN)}))
    if strategy == "entropy":
        best, score = max(((i, single(i)) for i in open_), key=lambda x: x[1])
    else:
        now = total_entropy(b)
        best, score = open_[0], float("-inf")
        for i in open_:
            p, gain, weight = b.p.get(i, UNKNOWN), 0.0, 0.0
            for level, value in FAMILIARITY.items():
                w = 1 - abs(p - value)
                trial = Beliefs(dict(b.p), set(b.assessed), [], b.bayesian and simulate_with_state, b.network)
                gain += w * (now - total_entropy(answer(graph, trial, i, level)))
                weight += w
            gain = gain / weight if weight else 0.0
            if gain > score:
                best, score = i, gain
    return {"node": best, "score": score, "question": question_type(len(b.history), len(open_), b.p.get(best, UNKNOWN))}


def probe_batch(graph: Graph, b: Beliefs, n: int, strategy: str = "eig") -> list[dict]:
    """n probes, each chosen as if the ones before had their likeliest answers; b stays as it is."""
    trial, out = copy.deepcopy(b), []
    for _ in range(n):
        probe = next_probe(graph, trial, strategy)
        if probe is None:
            break
        out.append(probe)
        p = trial.p.get(probe["node"], UNKNOWN)
        answer(graph, trial, probe["node"], min(FAMILIARITY, key=lambda f: abs(FAMILIARITY[f] - p)))
    return out


def false_alarm_factor(foils: list[str]) -> float:
    """1 less the share of made-up items that a learner claims to know at least basically; 1 without foils."""
    return 1 - sum(f in ("basic", "solid", "deep") for f in foils) / len(foils) if foils else 1.0


def discounted(graph: Graph | None, b: Beliefs, factor: float) -> Beliefs:
    """Beliefs above one half pulled towards it by factor, in place; with a graph they are swept again."""
    factor = min(1.0, max(0.0, factor))
    for i, p in b.p.items():
        if p > 0.5:
            b.p[i] = 0.5 + (p - 0.5) * factor
    if graph is not None:
        spread(graph, b, None, None)
    return b


def simulated(graph: Graph, answers: DataFrame, bayesian: bool = False, noisy: bool = False) -> DataFrame:
    """(session_id, node, p, assessed) after the answers(session_id, seq, node, familiarity) of each session, in order of seq."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        b = start(graph, bayesian=bayesian)
        for row in pdf.sort_values("seq", kind="stable").itertuples():
            answer(graph, b, row.node, row.familiarity, noisy)
        return pd.DataFrame([(pdf.session_id.iloc[0], i, p, i in b.assessed) for i, p in b.p.items()], columns=["session_id", "node", "p", "assessed"])

    return answers.groupBy("session_id").applyInPandas(run, "session_id bigint, node string, p double, assessed boolean")


def probing_trials(graph: Graph, trials: DataFrame, questions: int, overclaim: float = 0.0, bayesian: bool = False) -> DataFrame:
    """(trial, strategy, asked, accuracy, entropy): Monte-Carlo learners, one task a trial; trials(trial bigint, strategy string).

    A learner knows a node only if its prerequisites are known. Strategies: eig, entropy, random, level, degree.
    """
    import numpy as np

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in pdf.itertuples():
            rng = np.random.default_rng([int(row.trial), 11])
            truth: dict[str, str] = {}
            for i in graph.order():
                ready = all(truth.get(q, "none") in ("basic", "solid", "deep") for q in graph.before.get(i, []))
                p = graph.prior(i)
                truth[i] = str(rng.choice(["solid", "basic", "heard_of", "none"], p=[p / 2, p / 2, (1 - p) / 2, (1 - p) / 2])) if ready else str(rng.choice(["none", "heard_of"]))
            b = start(graph, bayesian=bayesian)
            for asked in range(1, questions + 1):
                open_ = [i for i in graph.nodes if i not in b.assessed]
                if not open_:
                    break
                if row.strategy in ("eig", "entropy"):
                    probe = next_probe(graph, b, row.strategy)
                    node = probe["node"] if probe else open_[0]
                elif row.strategy == "level":
                    node = min(open_, key=lambda i: (graph.nodes[i].get("level") or 2, i))
                elif row.strategy == "degree":
                    node = min(open_, key=lambda i: (-len(graph.after[i]) - len(graph.before[i]), i))
                else:
                    node = str(rng.choice(open_))
                said = truth[node]
                if said in ("none", "heard_of") and rng.random() < overclaim:
                    said = "basic"
                answer(graph, b, node, said)
                right = sum((b.p[i] >= 0.5) == (truth[i] in ("basic", "solid", "deep")) for i in graph.nodes)
                out.append((row.trial, row.strategy, asked, right / len(graph.nodes), total_entropy(b)))
        return pd.DataFrame(out, columns=["trial", "strategy", "asked", "accuracy", "entropy"])

    return trials.groupBy("trial", "strategy").applyInPandas(run, "trial bigint, strategy string, asked int, accuracy double, entropy double")


def network_sweep(graph: Graph, answers: DataFrame, truth: DataFrame, grid: list[Network]) -> DataFrame:
    """(ready, anyway, cut, accuracy) of every network of a grid, best first: share of truth(session_id, node, known) that the beliefs after answers(session_id, seq, node, familiarity) get right at 0.5."""
    rows = answers.sparkSession.createDataFrame([(n.ready, n.anyway, n.cut) for n in grid], "ready double, anyway double, cut double")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (session, ready, anyway, cut), part in pdf.groupby(["session_id", "ready", "anyway", "cut"]):
            b = start(graph, bayesian=True, network=Network(ready, anyway, cut))
            for row in part.sort_values("seq", kind="stable").itertuples():
                answer(graph, b, row.node, row.familiarity)
            out += [(session, ready, anyway, cut, i, p) for i, p in b.p.items()]
        return pd.DataFrame(out, columns=["session_id", "ready", "anyway", "cut", "node", "p"])

    beliefs = answers.crossJoin(F.broadcast(rows)).groupBy("session_id").applyInPandas(run, "session_id bigint, ready double, anyway double, cut double, node string, p double")  # the grid is given row by row
    right = ((F.col("p") >= 0.5) == F.col("known")).cast("int")
    return beliefs.join(truth, ["session_id", "node"]).groupBy("ready", "anyway", "cut").agg(F.avg(right).alias("accuracy")).orderBy(F.desc("accuracy"), "ready", "anyway", "cut")


def chain(n: int) -> list[dict]:
    return [{"id": f"n{i}", "title": f"n{i}", "level": i + 1, "obscurity": 1 + i % 5, "prerequisites": [f"n{i - 1}"] if i else []} for i in range(n)]


def tree(n: int, fan: int = 2) -> list[dict]:
    return [{"id": f"n{i}", "title": f"n{i}", "level": 1, "obscurity": 1 + i % 5, "prerequisites": [f"n{(i - 1) // fan}"] if i else []} for i in range(n)]


def flat(n: int) -> list[dict]:
    return [{"id": f"n{i}", "title": f"n{i}", "level": 1, "obscurity": 1 + i % 5, "prerequisites": []} for i in range(n)]


def dense(n: int, needs: int = 3) -> list[dict]:
    return [{"id": f"n{i}", "title": f"n{i}", "level": 1 + i // 4, "obscurity": 1 + i % 5, "prerequisites": [f"n{j}" for j in range(max(0, i - needs), i)]} for i in range(n)]


# The same questions about many sessions at once: beliefs(session_id, node, p, assessed), nodes(node, level), links(before, after).


def node_table(spark: SparkSession, graph: Graph) -> DataFrame:
    rows = [(i, n.get("title"), n.get("level"), n.get("obscurity"), graph.before[i]) for i, n in graph.nodes.items()]
    return spark.createDataFrame(rows, "node string, title string, level int, obscurity int, prerequisites array<string>")


def links(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.explode("prerequisites").alias("before"), F.col("node").alias("after"))


def prior(obscurity: Column) -> Column:
    return F.greatest(F.lit(0.05), 0.5 - 0.08 * F.coalesce(obscurity, F.lit(3)))


def band(p: Column) -> Column:
    return F.when(p >= 0.7, "known").when(p <= 0.2, "unknown").otherwise("uncertain")


def coverage(beliefs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(session_id, level, known, unknown, uncertain, total, percent_known)."""
    state = band(F.col("p"))
    count = lambda name: F.count_if(state == name).alias(name)
    out = beliefs.join(nodes.select("node", F.coalesce("level", F.lit(2)).alias("level")), "node").groupBy("session_id", "level").agg(count("known"), count("unknown"), count("uncertain"), F.count("*").alias("total"))
    return out.withColumn("percent_known", F.round(100.0 * F.col("known") / F.col("total"), 1))


def coverage_lists(beliefs: DataFrame) -> DataFrame:
    """(session_id, known, unknown, uncertain): nodes from sure to less sure, the uncertain ones by entropy; ties by node."""
    state = band(F.col("p"))

    def nodes(name: str, key: Column) -> Column:
        return F.transform(F.sort_array(F.collect_list(F.when(state == name, F.struct(key.alias("k"), F.col("node").alias("node"))))), lambda s: s["node"]).alias(name)

    return beliefs.groupBy("session_id").agg(nodes("known", -F.col("p")), nodes("unknown", F.col("p")), nodes("uncertain", -entropy(F.col("p"))))


def converged(beliefs: DataFrame, most: int = 3) -> DataFrame:
    """(session_id, entropy, open, converged): at most `most` beliefs strictly between 0.2 and 0.8."""
    open_ = F.count_if((F.col("p") > 0.2) & (F.col("p") < 0.8))
    return beliefs.groupBy("session_id").agg(F.sum(entropy(F.col("p"))).alias("entropy"), open_.alias("open"), (open_ <= most).alias("converged"))


def fringes(beliefs: DataFrame, edges: DataFrame, cut: float = 0.7) -> DataFrame:
    """(session_id, node, fringe): inner nodes are known with an unknown child, outer ones unknown with all prerequisites known."""
    state = beliefs.select("session_id", "node", (F.col("p") >= cut).alias("known"))
    child = state.join(edges.select(F.col("before").alias("node"), F.col("after").alias("c")), "node").join(state.select("session_id", F.col("node").alias("c"), F.col("known").alias("ck")), ["session_id", "c"])
    inner = child.where("known").groupBy("session_id", "node").agg(F.bool_and("ck").alias("all")).where("not all")
    needs = state.join(edges.select(F.col("after").alias("node"), F.col("before").alias("q")), "node", "left").join(state.select("session_id", F.col("node").alias("q"), F.col("known").alias("qk")), ["session_id", "q"], "left")
    outer = needs.where("not known").groupBy("session_id", "node").agg(F.bool_and(F.col("q").isNull() | F.coalesce("qk", F.lit(False))).alias("all")).where("all")
    return inner.select("session_id", "node", F.lit("inner").alias("fringe")).unionByName(outer.select("session_id", "node", F.lit("outer").alias("fringe")))


def open_nodes(beliefs: DataFrame) -> DataFrame:
    """Candidates of the next probe: not assessed and neither nearly known nor nearly unknown."""
    return beliefs.where(~F.col("assessed") & F.coalesce("p", F.lit(UNKNOWN)).between(0.05, 0.85))


def graph_problems(nodes: DataFrame) -> DataFrame:
    """(node, problem) of descriptions that run on or say nothing, and of obscure nodes without prerequisites; nodes with a description."""
    said = F.trim(F.coalesce("description", F.lit("")))
    parts = F.filter(F.split(said, r"\. "), lambda s: F.trim(s) != "")
    checks = (("several ideas", F.size(parts) >= 3), ("obscure without prerequisites", (F.coalesce("obscurity", F.lit(3)) >= 4) & (F.size(F.coalesce("prerequisites", F.array().cast("array<string>"))) == 0)), ("no description", F.length(said) < 10))
    found = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in checks]), lambda x: x.isNotNull())
    return nodes.select("node", F.explode(found).alias("problem"))
