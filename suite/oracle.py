"""DuckDB SQL for every registered query: visits unrolled hop by hop as plain CTEs.

The SQL keeps every (query, star, seed) apart and knows nothing of shared walks,
layouts or frontiers, so it checks those too.
"""

from __future__ import annotations

ALPHA, BETA = "0.9e0", "0.8e0"
NORM = f"pow({ALPHA}, -{ALPHA})"
DIGITS = 9


def _id(kind: int, key: str) -> str:
    return f"({kind} * 1000000000::BIGINT + {key})"


_BRAND = "CAST(split_part(p_brand, '#', 2) AS BIGINT)"

NODES = f"""
SELECT {_id(0, 'p_partkey')} AS node_id, 0 AS type_id, p_name AS name FROM part
UNION ALL SELECT {_id(1, 's_suppkey')}, 1, s_name FROM supplier
UNION ALL SELECT DISTINCT {_id(2, _BRAND)}, 2, p_brand FROM part
UNION ALL SELECT {_id(3, 'c_custkey')}, 3, c_name FROM customer
UNION ALL SELECT {_id(4, 'o_orderkey')}, 4, 'ORDER_' || o_orderkey FROM orders
UNION ALL SELECT {_id(5, 'n_nationkey')}, 5, n_name FROM nation
UNION ALL SELECT {_id(6, 'r_regionkey')}, 6, r_name FROM region
"""

ONE_WAY = f"""
SELECT {_id(0, 'p_partkey')} AS src, {_id(2, _BRAND)} AS dst, 1 AS level FROM part
UNION ALL SELECT DISTINCT {_id(0, 'l_partkey')}, {_id(1, 'l_suppkey')}, 0 FROM lineitem
UNION ALL SELECT DISTINCT {_id(0, 'l_partkey')}, {_id(4, 'l_orderkey')}, 0 FROM lineitem
UNION ALL SELECT {_id(4, 'o_orderkey')}, {_id(3, 'o_custkey')}, 0 FROM orders
UNION ALL SELECT {_id(3, 'c_custkey')}, {_id(5, 'c_nationkey')}, 1 FROM customer
UNION ALL SELECT {_id(1, 's_suppkey')}, {_id(5, 's_nationkey')}, 1 FROM supplier
UNION ALL SELECT {_id(5, 'n_nationkey')}, {_id(6, 'n_regionkey')}, 1 FROM nation
"""


def graph_ctes(keep: str | None = None) -> list[str]:
    """CTEs nodes and edges; ``keep`` is a predicate on {id}."""
    nodes = f"SELECT * FROM ({NODES})"
    edges = "SELECT src, dst, level FROM one_way UNION ALL SELECT dst, src, -level FROM one_way"
    if keep:
        nodes += " WHERE " + keep.format(id="node_id")
        edges = f"SELECT * FROM ({edges}) WHERE {keep.format(id='src')} AND {keep.format(id='dst')}"
    return [
        f"nodes AS MATERIALIZED ({nodes})",
        f"one_way AS MATERIALIZED ({ONE_WAY})",
        f"edges AS MATERIALIZED ({edges})",
    ]


def fraction(ratio: float) -> str:
    return f"('0x' || substr(md5(CAST({{id}} AS VARCHAR)), 1, 8))::BIGINT < {int(ratio * 2**32)}"


def inherit_rule(a: str, b: str) -> str:
    return (
        f"(({a} = 2 AND {b} = 0) OR ({a} = 0 AND {b} = 2)"
        f" OR {a} IN (5, 6) OR {b} IN (5, 6))"
    )


def query_ctes(chains: dict[int, list], prefix: str = "") -> list[str]:
    """CTEs seeds and stars from literal chains."""
    seeds = [
        f"({q}, {s}, {seed}::BIGINT, {kind})"
        for q, chain in chains.items()
        for s, (star_seeds, _) in enumerate(chain)
        for seed, kind in star_seeds
    ]
    stars = [f"({q}, {s}, {dst})" for q, chain in chains.items() for s, (_, dst) in enumerate(chain)]
    return [
        f"{prefix}seeds(query_id, star_id, seed_id, seed_type) AS (VALUES {', '.join(seeds)})",
        f"{prefix}stars(query_id, star_id, dst_type) AS (VALUES {', '.join(stars)})",
    ]


def visit_ctes(
    hops: int,
    p: str = "",
    hierarchy: bool = True,
    prune_k: int | None = None,
    coverage: bool = False,
    link: bool = False,
) -> list[str]:
    """CTEs {p}uses and {p}f0..{p}v{hops}; {p}visit is the union of all hops.

    ``link`` expects {p}targets(query_id, star_id, node_id, target_score) and
    {p}seed_scores(query_id, star_id, seed_id, seed_score).
    """
    rule = inherit_rule("s.seed_type", "t.dst_type") if hierarchy else "FALSE"
    key = "query_id, star_id, seed_id"
    cols = f"{key}, node_id, dist, n_paths, hier, closeness, lb, parent_id"
    out = [
        f"""{p}uses AS MATERIALIZED (
  SELECT s.query_id, s.star_id, s.seed_id, s.seed_type, t.dst_type, {rule} AS inh,
         COUNT(*) OVER (PARTITION BY s.query_id, s.star_id) AS n_seeds
  FROM {p}seeds s JOIN {p}stars t ON s.query_id = t.query_id AND s.star_id = t.star_id)""",
        f"""{p}f0 AS MATERIALIZED (
  SELECT {key}, seed_id AS node_id, 0 AS dist, 1.0e0 AS n_paths, 0.0e0 AS hier,
         0.0e0 AS closeness, 1.0e0 AS lb, NULL::BIGINT AS parent_id
  FROM {p}uses WHERE seed_id IN (SELECT node_id FROM nodes))""",
        f"{p}v0 AS (SELECT * FROM {p}f0)",
    ]
    if prune_k:
        out.append(
            f"""{p}th0 AS (SELECT DISTINCT query_id, star_id, 0.0e0 AS th_lb, -1.0e0 AS th_sc FROM {p}uses)"""
        )
    if coverage:
        out.append(f"{p}run0 AS (SELECT DISTINCT query_id, star_id FROM {p}uses)")
    for t in range(1, hops + 1):
        sender = f"{p}f{t - 1}"
        if t > 1 and prune_k:
            out += _prune_ctes(p, t - 1, prune_k, link)
            sender = f"{p}fr{t - 1}"
        if t > 1 and coverage:
            out += _coverage_ctes(p, t - 1, link)
            sender = f"{p}fr{t - 1}"
        out += [
            f"""{p}m{t} AS (
  SELECT f.query_id, f.star_id, f.seed_id, e.dst AS node_id,
         SUM(f.n_paths) AS n_paths,
         MAX(f.hier + CASE WHEN u.inh THEN {BETA} * abs(e.level) ELSE 0 END) AS hier,
         MAX({BETA} * abs(e.level)) AS edge,
         SUM(f.lb) AS plb, MIN(f.node_id) AS parent_id
  FROM {sender} f
  JOIN {p}uses u ON u.query_id = f.query_id AND u.star_id = f.star_id AND u.seed_id = f.seed_id
  JOIN edges e ON e.src = f.node_id
  GROUP BY f.query_id, f.star_id, f.seed_id, e.dst)""",
            f"""{p}f{t} AS MATERIALIZED (
  SELECT {key}, node_id, {t} AS dist, n_paths, hier,
         LEAST({NORM} * pow({ALPHA}, {t} - (hier - edge)), n_paths * pow({ALPHA}, {t} - hier)) AS closeness,
         LEAST({NORM} * pow({ALPHA}, {t} - (hier - edge)), pow({ALPHA}, 1 - edge) * plb) AS lb,
         parent_id
  FROM {p}m{t} m
  WHERE NOT EXISTS (SELECT 1 FROM {p}v{t - 1} v WHERE v.query_id = m.query_id
    AND v.star_id = m.star_id AND v.seed_id = m.seed_id AND v.node_id = m.node_id))""",
            f"{p}v{t} AS MATERIALIZED (SELECT {cols} FROM {p}v{t - 1} UNION ALL SELECT {cols} FROM {p}f{t})",
        ]
    out.append(
        f"""{p}visit AS MATERIALIZED (
  SELECT v.*, u.seed_type, u.dst_type, u.inh, u.n_seeds, n.type_id
  FROM {p}v{hops} v
  JOIN {p}uses u ON u.query_id = v.query_id AND u.star_id = v.star_id AND u.seed_id = v.seed_id
  JOIN nodes n ON n.node_id = v.node_id)"""
    )
    return out


def _prune_ctes(p: str, t: int, k: int, link: bool) -> list[str]:
    totals = f"""{p}tot{t} AS MATERIALIZED (
  SELECT v.query_id, v.star_id, v.node_id, ROUND(SUM(v.closeness), {DIGITS}) AS score,
         ROUND(SUM(v.lb), {DIGITS}) AS lb, COUNT(*) = MAX(u.n_seeds) AS complete,
         MAX(n.type_id) = MAX(u.dst_type) AS wanted
  FROM {p}v{t} v
  JOIN {p}uses u ON u.query_id = v.query_id AND u.star_id = v.star_id AND u.seed_id = v.seed_id
  JOIN nodes n ON n.node_id = v.node_id
  GROUP BY v.query_id, v.star_id, v.node_id)"""
    if link:
        found = f"""{p}found{t} AS (
  SELECT v.query_id, v.star_id, ROUND(MIN(x.lb + ss.seed_score), {DIGITS}) AS th_lb,
         ROUND(MIN(v.closeness), {DIGITS}) AS th_sc
  FROM {p}v{t} v
  JOIN {p}targets g ON g.query_id = v.query_id AND g.star_id = v.star_id AND g.node_id = v.node_id
  JOIN {p}tot{t} x ON x.query_id = v.query_id AND x.star_id = v.star_id AND x.node_id = v.node_id
  JOIN {p}seed_scores ss ON ss.query_id = v.query_id AND ss.star_id = v.star_id AND ss.seed_id = v.seed_id
  GROUP BY v.query_id, v.star_id HAVING COUNT(*) > {k})"""
    else:
        found = f"""{p}found{t} AS (
  SELECT query_id, star_id, MIN(lb) FILTER (WHERE r <= {k}) AS th_lb,
         MIN(score) FILTER (WHERE r <= {k}) AS th_sc
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id, star_id ORDER BY score DESC, node_id) AS r
        FROM {p}tot{t} WHERE complete AND wanted)
  GROUP BY query_id, star_id HAVING COUNT(*) > {k})"""
    return [
        totals,
        found,
        f"""{p}th{t} AS (
  SELECT b.query_id, b.star_id, COALESCE(f.th_lb, b.th_lb) AS th_lb, COALESCE(f.th_sc, b.th_sc) AS th_sc
  FROM {p}th{t - 1} b LEFT JOIN {p}found{t} f ON f.query_id = b.query_id AND f.star_id = b.star_id)""",
        f"""{p}fr{t} AS MATERIALIZED (
  SELECT f.* FROM {p}f{t} f
  JOIN {p}tot{t} x ON x.query_id = f.query_id AND x.star_id = f.star_id AND x.node_id = f.node_id
  JOIN {p}th{t} h ON h.query_id = f.query_id AND h.star_id = f.star_id
  WHERE NOT (x.lb <> 0 AND x.lb <= h.th_lb) AND NOT (x.complete AND x.score <= h.th_sc))""",
    ]


def _coverage_ctes(p: str, t: int, link: bool) -> list[str]:
    if link:
        wanted = (
            f"EXISTS (SELECT 1 FROM {p}targets g WHERE g.query_id = v.query_id"
            " AND g.star_id = v.star_id AND g.node_id = v.node_id)"
        )
        total = f"(SELECT COUNT(*) FROM {p}targets g WHERE g.query_id = c.query_id AND g.star_id = c.star_id)"
    else:
        wanted = "n.type_id = u.dst_type"
        total = "(SELECT COUNT(*) FROM nodes n WHERE n.type_id = c.dst_type)"
    before = f"COUNT(*) FILTER (WHERE first_hop < {t})" if t > 1 else "0"
    return [
        f"""{p}cov{t} AS MATERIALIZED (
  SELECT query_id, star_id, MAX(dst_type) AS dst_type, COUNT(*) AS now_seen, {before} AS before_seen,
         COUNT(*) FILTER (WHERE wanted AND seen = n_seeds) AS complete
  FROM (
    SELECT v.query_id, v.star_id, v.node_id, MIN(v.dist) AS first_hop, COUNT(*) AS seen,
           MAX(u.n_seeds) AS n_seeds, MAX(u.dst_type) AS dst_type, BOOL_OR({wanted}) AS wanted
    FROM {p}v{t} v
    JOIN {p}uses u ON u.query_id = v.query_id AND u.star_id = v.star_id AND u.seed_id = v.seed_id
    JOIN nodes n ON n.node_id = v.node_id
    GROUP BY v.query_id, v.star_id, v.node_id)
  GROUP BY query_id, star_id)""",
        f"""{p}run{t} AS MATERIALIZED (
  SELECT c.query_id, c.star_id FROM {p}cov{t} c
  JOIN {p}run{t - 1} r ON r.query_id = c.query_id AND r.star_id = c.star_id
  WHERE now_seen <> before_seen AND complete < {total}
    AND now_seen < (SELECT COUNT(*) FROM nodes))""",
        f"""{p}fr{t} AS (
  SELECT f.* FROM {p}f{t} f
  JOIN {p}run{t} r ON r.query_id = f.query_id AND r.star_id = f.star_id)""",
    ]


def answer_ctes(k: int, p: str = "") -> list[str]:
    """CTE {p}answers: ranked answers of every star of {p}visit."""
    return [
        f"""{p}cand AS (
  SELECT query_id, star_id, node_id, MAX(type_id) AS type_id, SUM(closeness) AS score,
         SUM(lb) AS lower_bound
  FROM {p}visit WHERE type_id = dst_type
  GROUP BY query_id, star_id, node_id HAVING COUNT(*) = MAX(n_seeds))""",
        f"""{p}answers AS MATERIALIZED (
  SELECT * FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id, star_id
                                 ORDER BY ROUND(score, {DIGITS}) DESC, node_id) AS rank
    FROM {p}cand) WHERE rank <= {k})""",
    ]


def link_ctes(hops: int, k: int, **options) -> list[str]:
    """CTE l_pairs: reached pairs of adjacent stars, from answers."""
    return [
        """l_seeds AS MATERIALIZED (
  SELECT a.query_id, a.star_id, a.node_id AS seed_id, a.type_id AS seed_type
  FROM answers a JOIN stars t ON t.query_id = a.query_id AND t.star_id = a.star_id + 1)""",
        "l_stars AS (SELECT query_id, star_id - 1 AS star_id, dst_type FROM stars WHERE star_id > 0)",
        """l_targets AS MATERIALIZED (
  SELECT query_id, star_id - 1 AS star_id, node_id, score AS target_score FROM answers WHERE star_id > 0)""",
        """l_seed_scores AS (SELECT query_id, star_id, node_id AS seed_id, score AS seed_score FROM answers)""",
        *visit_ctes(hops, "l_", link=True, **options),
        """l_pairs AS MATERIALIZED (
  SELECT v.query_id, v.star_id, v.seed_id AS source_id, v.node_id AS target_id, v.closeness,
         s.seed_score + v.closeness AS pair_score, g.target_score
  FROM l_visit v
  JOIN l_targets g ON g.query_id = v.query_id AND g.star_id = v.star_id AND g.node_id = v.node_id
  JOIN l_seed_scores s ON s.query_id = v.query_id AND s.star_id = v.star_id AND s.seed_id = v.seed_id)""",
    ]


def chain_sql(
    chains: dict[int, list],
    hops: int,
    k: int,
    extra: str = "",
    keep: str | None = None,
    star_k: int | None = None,
    queries: list[str] | None = None,
    **options,
) -> str:
    """Whole general query: all tuples of every chain, no partial pruning."""
    longest = max(len(c) for c in chains.values())
    ctes = graph_ctes(keep) + (queries or query_ctes(chains)) + visit_ctes(hops, **options)
    ctes += answer_ctes(star_k or k)
    ctes += link_ctes(hops, k, **options)
    ctes.append(
        """t1 AS (SELECT query_id, node_id AS last_id, [node_id] AS ids, CAST(score AS DECIMAL(28, 9)) AS score
  FROM answers WHERE star_id = 0)"""
    )
    for n in range(2, longest + 1):
        ctes.append(
            f"""t{n} AS (
  SELECT t.query_id, p.target_id AS last_id, list_append(t.ids, p.target_id) AS ids,
         CAST(t.score + CAST(p.closeness + p.target_score AS DECIMAL(28, 9)) AS DECIMAL(28, 9)) AS score
  FROM t{n - 1} t JOIN l_pairs p
    ON p.query_id = t.query_id AND p.star_id = {n - 2} AND p.source_id = t.last_id)"""
        )
    full = " UNION ALL ".join(
        f"SELECT * FROM t{n} WHERE query_id IN (SELECT query_id FROM stars GROUP BY query_id"
        f" HAVING COUNT(*) = {n})"
        for n in range(1, longest + 1)
    )
    ctes.append(f"full_tuples AS ({full})")
    return f"""{_with(ctes)}
SELECT {extra}query_id, rank, array_to_string(ids, ',') AS node_ids, ROUND(CAST(score AS DOUBLE), 6) AS score
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, ids) AS rank
      FROM full_tuples) WHERE rank <= {k}"""


def _with(ctes: list[str], recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes)


def star_sql(chains, hops: int, k: int, select: str, **options) -> str:
    ctes = graph_ctes() + query_ctes(chains) + visit_ctes(hops, **options) + answer_ctes(k)
    return f"{_with(ctes)}\n{select}"


ANSWER_COLUMNS = """query_id, star_id, rank, node_id, type_id, ROUND(score, 6) AS score,
       ROUND(lower_bound, 6) AS lower_bound, ROUND(lower_bound, 6) AS upper_bound"""
VISIT_COLUMNS = """query_id, star_id, seed_id, node_id, type_id, dist, n_paths, ROUND(hier, 6) AS hier,
       ROUND(closeness, 6) AS closeness, ROUND(lb, 6) AS lower_bound, parent_id"""


def graph_sql(select: str, keep: str | None = None) -> str:
    return f"{_with(graph_ctes(keep))}\n{select}"


TYPES = "(VALUES (0, 'PART'), (1, 'SUPPLIER'), (2, 'BRAND'), (3, 'CUSTOMER'), (4, 'ORDER'), (5, 'NATION'), (6, 'REGION'))"


def path_sql(chains, hops: int, k: int) -> str:
    ctes = graph_ctes() + query_ctes(chains) + visit_ctes(hops) + answer_ctes(k)
    ctes.append(
        """walk(query_id, star_id, node_id, seed_id, head, path) AS (
  SELECT v.query_id, v.star_id, v.node_id, v.seed_id, v.node_id, CAST(v.node_id AS VARCHAR)
  FROM visit v JOIN answers a ON a.query_id = v.query_id AND a.star_id = v.star_id AND a.node_id = v.node_id
  UNION ALL
  SELECT w.query_id, w.star_id, w.node_id, w.seed_id, v.parent_id, v.parent_id || ',' || w.path
  FROM walk w JOIN visit v ON v.query_id = w.query_id AND v.star_id = w.star_id
    AND v.seed_id = w.seed_id AND v.node_id = w.head
  WHERE v.parent_id IS NOT NULL)"""
    )
    return f"""{_with(ctes, recursive=True)}
SELECT query_id, star_id, node_id, seed_id, path FROM walk WHERE head = seed_id"""


def shortest_path_sql(src: int, dst: int, hops: int) -> str:
    chains = {1: [([(src, 0)], 0)]}
    ctes = graph_ctes() + query_ctes(chains) + visit_ctes(hops, hierarchy=False)
    ctes.append(
        f"""walk(head, path) AS (
  SELECT node_id, CAST(node_id AS VARCHAR) FROM visit WHERE node_id = {dst}
  UNION ALL
  SELECT v.parent_id, v.parent_id || ',' || w.path FROM walk w JOIN visit v ON v.node_id = w.head
  WHERE v.parent_id IS NOT NULL)"""
    )
    return f"""{_with(ctes, recursive=True)}
SELECT {src}::BIGINT AS src, {dst}::BIGINT AS dst,
       COALESCE((SELECT path FROM walk WHERE head = {src}), '') AS path"""
