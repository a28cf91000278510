"""Plain Python reading of the scoring model, for small graphs only."""

from __future__ import annotations

from collections import defaultdict
from itertools import product

ALPHA, BETA = 0.9, 0.8
NORM = ALPHA**-ALPHA


def synthetic_inherits(a: int, b: int) -> bool:
    return a in (2, 3) or b in (2, 3)


class BruteGraph:
    def __init__(self, types: dict[int, int], edges: dict[tuple[int, int], int]):
        self.types = types
        self.out = defaultdict(list)
        for (src, dst), level in edges.items():
            self.out[src].append((dst, level))

    def visit(self, seeds, dst_type, k=5, max_hops=None, stop="fixpoint", prune=None, targets=None, seed_scores=None):
        """State {(seed, node): (dist, paths, hier, closeness, bound, parent)}."""
        seeds = dict(seeds)
        inherit = {s: synthetic_inherits(t, dst_type) for s, t in seeds.items()}
        state = {(s, s): (0, 1, 0.0, 0.0, 1.0, None) for s in seeds if s in self.types}
        frontier, hop, theta, seen_before = set(state), 0, (0.0, -1.0), 0
        wanted = set(targets or []) if targets is not None else {n for n, t in self.types.items() if t == dst_type}
        while frontier and (max_hops is None or hop < max_hops):
            if hop:
                by_node = defaultdict(dict)
                for (s, n), row in state.items():
                    by_node[n][s] = row
                score = {n: round(sum(r[3] for r in d.values()), 9) for n, d in by_node.items()}
                bound = {n: round(sum(r[4] for r in d.values()), 9) for n, d in by_node.items()}
                complete = {n for n, d in by_node.items() if len(d) == len(seeds)}
                if prune:
                    theta = self.thresholds(
                        theta, state, score, bound, complete & wanted, k, targets, seed_scores
                    )
                    frontier = {
                        (s, n)
                        for s, n in frontier
                        if not (bound[n] != 0 and bound[n] <= theta[0])
                        and not (n in complete and score[n] <= theta[1])
                    }
                if stop == "coverage":
                    done = len(complete & wanted) >= len(wanted)
                    if len(by_node) == seen_before or done or len(by_node) >= len(self.types):
                        break
                    seen_before = len(by_node)
            hop += 1
            sent = defaultdict(list)
            for s, n in frontier:
                for dst, level in self.out[n]:
                    if (s, dst) not in state:
                        sent[s, dst].append((n, BETA * abs(level), state[s, n]))
            for (s, n), parents in sent.items():
                hier = max(r[2] + (e if inherit[s] else 0.0) for _, e, r in parents)
                edge = max(e for _, e, _ in parents)
                paths = sum(r[1] for _, _, r in parents)
                cap = NORM * ALPHA ** (hop - (hier - edge))
                close = min(cap, paths * ALPHA ** (hop - hier))
                low = min(cap, ALPHA ** (1 - edge) * sum(r[4] for _, _, r in parents))
                state[s, n] = (hop, paths, hier, close, low, min(p for p, _, _ in parents))
            frontier = set(sent)
        return state

    def thresholds(self, theta, state, score, bound, found, k, targets, seed_scores):
        if targets is None:
            if len(found) <= k:
                return theta
            best = sorted(found, key=lambda n: (-score[n], n))[:k]
            return min(bound[n] for n in best), min(score[n] for n in best)
        pairs = [(s, n) for s, n in state if n in targets]
        if len(pairs) <= k:
            return theta
        return (
            round(min(bound[n] + seed_scores[s] for s, n in pairs), 9),
            round(min(state[p][3] for p in pairs), 9),
        )

    def star(self, seeds, dst_type, k=5, **options):
        """Ranked [(node, score)]."""
        state = self.visit(seeds, dst_type, k=k, **options)
        by_node = defaultdict(list)
        for (_, n), row in state.items():
            by_node[n].append(row[3])
        scores = [
            (n, sum(v))
            for n, v in by_node.items()
            if len(v) == len(dict(seeds)) and self.types[n] == dst_type
        ]
        return sorted(scores, key=lambda x: (-round(x[1], 9), x[0]))[:k]

    def chain(self, stars, k=5, star_k=None, **options):
        """Ranked [(node ids, total)] over every combination of star answers."""
        answers = [dict(self.star(seeds, t, k=star_k or k, **options)) for seeds, t in stars]
        links = []
        for i in range(len(stars) - 1):
            if not answers[i]:
                return []
            seeds = [(n, self.types[n]) for n in answers[i]]
            state = self.visit(
                seeds, stars[i + 1][1], k=k, targets=set(answers[i + 1]), seed_scores=answers[i], **options
            )
            links.append({p: row[3] for p, row in state.items()})
        out = []
        for ids in product(*answers):
            steps = list(zip(ids, ids[1:]))
            if all(step in link for step, link in zip(steps, links)):
                total = sum(a[n] for a, n in zip(answers, ids))
                total += sum(link[step] for step, link in zip(steps, links))
                out.append((list(ids), total))
        return sorted(out, key=lambda x: (-round(x[1], 9), x[0]))[:k]
