"""SQL for the same answers, for a database that runs it over the same tables."""

from __future__ import annotations

from hopweave.operators.sampling import Config

_LINES = "lines AS (SELECT l_orderkey o, l_linenumber::BIGINT l, l_partkey p, l_suppkey s, l_quantity q, l_extendedprice x, epoch_us(l_shipdate)::DOUBLE ts FROM lineitem)"

PART_SUPP = [_LINES, "e AS MATERIALIZED (SELECT p AS src, s AS dst, q AS weight, ts, row_number() OVER (ORDER BY p, o, l, p, s, q, x) - 1 AS eid FROM lines)", "nodes AS (SELECT p_partkey AS id FROM part)"]

TRADE = [
    _LINES,
    "sizes AS (SELECT (SELECT count(*) FROM customer) AS c, (SELECT count(*) FROM part) AS p, (SELECT count(*) FROM supplier) AS s)",
    "one AS (SELECT o_custkey AS src, p + (SELECT c FROM sizes) AS dst, 0 AS kind, lines.* FROM lines JOIN orders ON o_orderkey = o)",
    "two AS (SELECT p + (SELECT c FROM sizes) AS src, s + (SELECT c + p FROM sizes) AS dst, 1 AS kind, lines.* FROM lines)",
    "raw AS (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT dst, src, kind + 2, o, l, p, s, q, x, ts FROM one UNION ALL SELECT dst, src, kind + 2, o, l, p, s, q, x, ts FROM two)",
    "e AS MATERIALIZED (SELECT src, dst, q AS weight, ts, row_number() OVER (ORDER BY src, kind, o, l, p, s, q, x) - 1 AS eid FROM raw)",
    "nodes AS (SELECT range AS id FROM range((SELECT c + p + s FROM sizes)))",
]

#: Every part, in batches of 128.
PART_SEEDS = ["places AS (SELECT p_partkey AS part, p_partkey AS pos FROM part)", "seeds AS (SELECT pos // 128 AS batch, pos % 128 AS pos, part AS node, NULL::DOUBLE AS time FROM places)"]
TRADE_SEEDS = [PART_SEEDS[0], "seeds AS (SELECT pos // 128 AS batch, pos % 128 AS pos, part + (SELECT c FROM sizes) AS node, epoch_us(TIMESTAMP '1996-06-01')::DOUBLE + pos * 1000000 AS time FROM places)"]
#: With each fourth seed once more.
DOUBLED_SEEDS = [PART_SEEDS[0], "seeds AS (SELECT batch, pos, node, time FROM (SELECT pos // 128 AS batch, pos % 128 AS pos, part + (SELECT c FROM sizes) AS node, NULL::DOUBLE AS time FROM places) UNION ALL SELECT pos // 128, 1000 + pos % 128, part + (SELECT c FROM sizes), NULL::DOUBLE FROM places WHERE pos % 4 = 0)"]


def with_(ctes: list[str], select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def _key(seed: int, *parts: str) -> str:
    return "md5(concat_ws('|', '" + str(seed) + "', " + ", ".join(f"({p})::VARCHAR" for p in parts) + "))"


def _unit(digest: str) -> str:
    return f"((('0x' || substr({digest}, 1, 13))::UBIGINT)::DOUBLE + 1) / 4503599627370496.0"


def _below(digest: str, n: str) -> str:
    return f"(('0x' || substr({digest}, 1, 12))::UBIGINT)::BIGINT % {n}"


def _floyd(k: int, key) -> str:
    """Columns p0..: k different places among `degree`; key(i) is the digest of step i."""
    steps = []
    for i in range(k):
        drawn = _below(key(i), f"greatest(degree - {k} + {i} + 1, 1)")
        taken = f"CASE WHEN t{i} IN ({', '.join(f'p{j}' for j in range(i))}) THEN degree - {k} + {i} ELSE t{i} END AS p{i}" if i else "t0 AS p0"
        steps.append(f"{drawn} AS t{i}, {taken}")
    return ", ".join(steps)


def _places(k: int) -> str:
    return f"unnest(CASE WHEN degree <= {k} THEN range(degree) ELSE [{', '.join(f'p{j}' for j in range(k))}] END)"


def khop(config: Config) -> list[str]:
    """CTEs over e and seeds that end in nall (nodes), dall (edges) and s (seeds)."""
    c, group = config, "batch, block"
    out = [
        f"s AS (SELECT batch, {'pos' if c.disjoint else '0::BIGINT'} AS block, pos, node, time AS bound FROM seeds)",
        "n0 AS MATERIALIZED (SELECT batch, block, row_number() OVER (PARTITION BY batch, block ORDER BY first_pos) - 1 AS local, node, 0::BIGINT AS hop, bound FROM (SELECT batch, block, node, min(pos) AS first_pos, min(coalesce(bound, 'infinity'::DOUBLE)) AS bound FROM s GROUP BY ALL))",
        "v0 AS (SELECT * FROM n0)",
    ]
    for h, k in enumerate(c.fanout, 1):
        frontier = f"v{h - 1}" if c.cumulative else f"n{h - 1}"
        base = f"SELECT f.batch, f.block, e.src, e.dst, e.eid, e.weight, e.ts, f.local AS parent, f.bound FROM {frontier} f JOIN e ON e.src = f.node"
        key = lambda *x: _key(c.seed, "batch", "block", str(h), "src", *x)  # noqa: B023, E731
        if c.temporal:
            base += " WHERE e.ts < f.bound"
        if c.replace and not c.temporal:
            rows = f"SELECT f.batch, f.block, f.node AS src, f.local AS parent, f.bound, i.i, r.start, r.degree, r.total FROM {frontier} f JOIN (SELECT src, min(eid) AS start, count(*) AS degree, sum(weight) AS total FROM e GROUP BY src) r ON r.src = f.node, range({k}) i(i)"
            if not c.weighted:
                body = f"SELECT t.batch, t.block, t.src, e.dst, e.eid, t.parent, e.ts FROM (SELECT *, start + {_below(key('i'), 'degree')} AS place FROM ({rows})) t JOIN e ON e.eid = t.place"
            else:
                curve = "SELECT *, coalesce(lag(high) OVER (PARTITION BY src ORDER BY eid), 0.0) AS low, eid = max(eid) OVER (PARTITION BY src) AS ending FROM (SELECT src, dst, eid, ts, sum(weight) OVER (PARTITION BY src ORDER BY eid ROWS UNBOUNDED PRECEDING) AS high FROM e)"
                body = f"SELECT t.batch, t.block, t.src, c.dst, c.eid, t.parent, c.ts FROM (SELECT *, (1.0::DOUBLE - {_unit(key('i'))}) * total AS x FROM ({rows})) t JOIN ({curve}) c ON c.src = t.src AND ((t.x >= c.low AND t.x < c.high) OR (c.ending AND t.x >= c.high))"
        elif not c.temporal and k > 0 and (not c.weighted or c.max_degree is not None):
            # so many places of a row; of weighted draws the cap's, of which the best are taken
            most, extra = (c.max_degree, ("'cap'",)) if c.weighted else (k, ())
            steps = _floyd(most, lambda i: _key(c.seed, "batch", "block", str(h), "f.node", *extra, str(i)))  # noqa: B023
            rows = f"SELECT f.batch, f.block, f.node AS src, f.local AS parent, r.start, r.degree, {steps} FROM {frontier} f JOIN (SELECT src, min(eid) AS start, count(*) AS degree FROM e GROUP BY src) r ON r.src = f.node"
            body = f"SELECT t.batch, t.block, t.src, e.dst, e.eid, t.parent, e.ts, e.weight FROM (SELECT *, {_places(most)} AS place FROM ({rows})) t JOIN e ON e.eid = t.start + t.place"
            if c.weighted:
                order = f"CASE WHEN weight > 0 AND isfinite(weight) THEN -ln({_unit(key('eid'))}) / weight ELSE 'infinity'::DOUBLE END, {key('eid')}, eid"
                body = f"SELECT * FROM ({body}) QUALIFY row_number() OVER (PARTITION BY batch, block, src ORDER BY {order}) <= {k}"
        else:
            if c.max_degree is not None and c.temporal == "uniform":
                base = f"SELECT * FROM ({base}) QUALIFY row_number() OVER (PARTITION BY batch, block, src ORDER BY {key(chr(39) + 'cap' + chr(39), 'eid')}, eid) <= {c.max_degree}"
            if c.temporal == "last":
                order = "ts DESC, eid DESC"
            elif c.weighted and not c.temporal:
                order = f"CASE WHEN weight > 0 AND isfinite(weight) THEN -ln({_unit(key('eid'))}) / weight ELSE 'infinity'::DOUBLE END, {key('eid')}, eid"
            else:
                order = f"{key('eid')}, eid"
            body = base if k < 0 else f"SELECT * FROM ({base}) QUALIFY row_number() OVER (PARTITION BY batch, block, src ORDER BY {order}) <= {k}"
        if c.cumulative and h > 1:
            body = f"SELECT * FROM ({body}) x WHERE NOT EXISTS (SELECT 1 FROM dd{h - 1} y WHERE y.batch = x.batch AND y.block = x.block AND y.eid = x.eid)"
        before = f"SELECT * FROM dd{h - 1} UNION ALL " if h > 1 else ""
        out += [
            f"d{h} AS MATERIALIZED (SELECT batch, block, {h}::BIGINT AS hop, src, dst, eid, parent, ts FROM ({body}))",
            f"dd{h} AS ({before}SELECT * FROM d{h})",
            f"w{h} AS (SELECT batch, block, dst AS node, min(parent * 10000000000 + eid) AS ord, min(ts) AS bound FROM d{h} GROUP BY ALL)",
            f"n{h} AS MATERIALIZED (SELECT w.batch, w.block, c.seen + row_number() OVER (PARTITION BY w.batch, w.block ORDER BY w.ord) - 1 AS local, w.node, {h}::BIGINT AS hop, w.bound FROM w{h} w JOIN (SELECT {group}, count(*) AS seen FROM v{h - 1} GROUP BY ALL) c ON c.batch = w.batch AND c.block = w.block WHERE NOT EXISTS (SELECT 1 FROM v{h - 1} v WHERE v.batch = w.batch AND v.block = w.block AND v.node = w.node))",
            f"v{h} AS (SELECT * FROM v{h - 1} UNION ALL SELECT * FROM n{h})",
        ]
    last = len(c.fanout)
    out.append(f"nall AS (SELECT batch, block, local, node, hop, bound FROM v{last})")
    edges = f"SELECT batch, block, hop, src, dst, eid FROM dd{last}"
    if c.subgraph == "induced":
        edges = "SELECT a.batch, a.block, 0::BIGINT AS hop, e.src, e.dst, e.eid FROM nall a JOIN e ON e.src = a.node JOIN nall b ON b.batch = a.batch AND b.block = a.block AND b.node = e.dst" + (" WHERE e.ts < a.bound" if c.temporal else "")
    elif c.subgraph == "bidirectional":
        out.append(f"fwd AS ({edges})")
        edges = "SELECT * FROM fwd UNION ALL SELECT batch, block, hop, dst, src, eid FROM (SELECT batch, block, src, dst, min(eid) AS eid, min(hop) AS hop FROM fwd WHERE src <> dst GROUP BY ALL) p WHERE NOT EXISTS (SELECT 1 FROM fwd f WHERE f.batch = p.batch AND f.block = p.block AND f.src = p.dst AND f.dst = p.src)"
    out.append(f"dall AS ({edges})")
    return out


EDGES_OUT = "SELECT batch, block, hop, src, dst, eid FROM dall"
NODES_OUT = "SELECT batch, block, local, node, hop FROM nall"
LOCAL_OUT = "SELECT d.batch, d.block, b.local AS edge_index_0, a.local AS edge_index_1, d.eid AS e_id, d.hop FROM dall d JOIN nall a ON a.batch = d.batch AND a.block = d.block AND a.node = d.src JOIN nall b ON b.batch = d.batch AND b.block = d.block AND b.node = d.dst"
SEEDS_OUT = "SELECT s.batch, s.block, s.pos, s.node, n.local FROM s JOIN nall n ON n.batch = s.batch AND n.block = s.block AND n.node = s.node"
COUNTS_OUT = "SELECT coalesce(n.batch, d.batch) AS batch, coalesce(n.block, d.block) AS block, coalesce(n.hop, d.hop) AS hop, coalesce(n.c, 0) AS num_nodes, coalesce(d.c, 0) AS num_edges FROM (SELECT batch, block, hop, count(*) AS c FROM nall GROUP BY ALL) n FULL JOIN (SELECT batch, block, hop, count(*) AS c FROM dall GROUP BY ALL) d ON n.batch = d.batch AND n.block = d.block AND n.hop = d.hop"


def hetero(fanout: dict, seed: int, types: list, raw: dict[tuple, str]) -> list[str]:
    """CTEs that end in hn (nodes) and hd (edges); raw: a SELECT of src, dst, eid for each edge type."""
    union = " UNION ALL ".join(f"SELECT '{s}' AS src_type, '{r}' AS rel, '{d}' AS dst_type, {types.index((s, r, d))}::BIGINT AS type_no, src, dst, eid FROM ({raw[s, r, d]})" for s, r, d in fanout)
    out = [
        f"he AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY type_no, dst ORDER BY eid) - 1 AS place FROM ({union}))",
        "hr AS (SELECT type_no, dst_type, dst, count(*) AS degree FROM he GROUP BY ALL)",
        "hn0 AS MATERIALIZED (SELECT batch, 'customer' AS node_type, row_number() OVER (PARTITION BY batch ORDER BY pos) - 1 AS local, node, 0::BIGINT AS hop FROM seeds)",
        "hv0 AS (SELECT * FROM hn0)",
    ]
    for h in range(1, len(next(iter(fanout.values()))) + 1):
        tries = []
        for t, k in fanout.items():
            if most := k[h - 1]:
                steps = _floyd(most, lambda i: _key(seed, "f.batch", str(h), "type_no", "f.node", str(i)))  # noqa: B023
                tries.append(f"SELECT batch, parent, type_no, dst, {_places(most)} AS place FROM (SELECT f.batch, f.local AS parent, type_no, dst, degree, {steps} FROM hn{h - 1} f JOIN hr ON hr.dst_type = f.node_type AND hr.dst = f.node WHERE type_no = {types.index(t)})")
        before = f"SELECT * FROM hdd{h - 1} UNION ALL " if h > 1 else ""
        out += [
            f"hd{h} AS MATERIALIZED (SELECT t.batch, {h}::BIGINT AS hop, e.src_type, e.rel, e.dst_type, e.src, e.dst, e.eid, t.parent, e.type_no FROM ({' UNION ALL '.join(tries)}) t JOIN he e ON e.type_no = t.type_no AND e.dst = t.dst AND e.place = t.place)",
            f"hdd{h} AS ({before}SELECT * FROM hd{h})",
            f"hw{h} AS (SELECT batch, src_type AS node_type, src AS node, min({{'t': dst_type, 'p': parent, 'n': type_no, 'e': eid}}) AS ord FROM hd{h} GROUP BY ALL)",
            f"hn{h} AS MATERIALIZED (SELECT w.batch, w.node_type, coalesce(c.seen, 0) + row_number() OVER (PARTITION BY w.batch, w.node_type ORDER BY w.ord) - 1 AS local, w.node, {h}::BIGINT AS hop FROM hw{h} w LEFT JOIN (SELECT batch, node_type, count(*) AS seen FROM hv{h - 1} GROUP BY ALL) c ON c.batch = w.batch AND c.node_type = w.node_type WHERE NOT EXISTS (SELECT 1 FROM hv{h - 1} v WHERE v.batch = w.batch AND v.node_type = w.node_type AND v.node = w.node))",
            f"hv{h} AS (SELECT * FROM hv{h - 1} UNION ALL SELECT * FROM hn{h})",
        ]
    last = len(next(iter(fanout.values())))
    return [*out, f"hn AS (SELECT * FROM hv{last})", f"hd AS (SELECT batch, hop, src_type, rel, dst_type, src, dst, eid FROM hdd{last})"]
