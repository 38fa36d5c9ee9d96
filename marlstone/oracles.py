"""Pieces of DuckDB SQL for the oracles: the adapter, clocks, kernels and averages in closed form, without chunks."""

from __future__ import annotations

HOUR = 3_600_000_000_000
BASE = f"""
ev AS (SELECT event_id AS seq, epoch_us(ts) * 1000 AS rx, user_id, event_type, value, CAST(regexp_extract(props, '-?[0-9]+') AS INT) AS k FROM events),
book AS (SELECT ['byb', 'bin', 'okx'][CAST(user_id % 3 AS INT) + 1] AS listing, seq, rx, rx - (k % 7) * 1000000000::BIGINT AS exchange_time,
  (100 + value / 100) - 0.01::DOUBLE * (1 + k % 5) AS bid_prc, (1 + k)::DOUBLE AS bid_qty, (100 + value / 100) + 0.01::DOUBLE * (1 + k % 5) AS ask_prc, (1 + (7 * k + 3) % 100)::DOUBLE AS ask_qty
  FROM ev WHERE event_type IN ('view', 'click', 'signup')),
trade AS (SELECT ['byb', 'bin', 'okx'][CAST(user_id % 3 AS INT) + 1] AS listing, seq, rx, rx - (k % 7) * 1000000000::BIGINT AS exchange_time,
  CASE WHEN k % 2 = 0 THEN 'Bid' ELSE 'Ask' END AS aggressor, 100 + value / 100 AS prc, (1 + k)::DOUBLE AS qty FROM ev WHERE event_type IN ('purchase', 'error')),
cbook AS (SELECT * REPLACE (rx - rx % {HOUR} AS rx) FROM book), ctrade AS (SELECT * REPLACE (rx - rx % {HOUR} AS rx) FROM trade),
ls AS (SELECT unnest(['byb', 'bin', 'okx']) AS listing),
clock AS (SELECT rx, row_number() OVER (ORDER BY rx) AS n FROM (SELECT DISTINCT rx FROM trade)),
anchors AS (SELECT unnest(range((SELECT rx FROM clock WHERE n = 101), (SELECT max(rx) FROM clock) - {HOUR}, {HOUR})) AS t),
rc AS (SELECT a.t, c.n AS c FROM anchors a ASOF LEFT JOIN clock c ON a.t >= c.rx),
rd AS (SELECT listing, t, c FROM rc CROSS JOIN ls),
mids AS (SELECT listing, rx, arg_max((bid_prc + ask_prc) / 2, seq) AS mid FROM book GROUP BY ALL),
moves AS (SELECT * FROM (SELECT listing, rx, ln(mid) - ln(lag(mid) OVER (PARTITION BY listing ORDER BY rx)) AS d FROM mids) WHERE d <> 0),
gaps AS (SELECT n, rx, coalesce((rx - lag(rx) OVER (ORDER BY rx)) / 1e9::DOUBLE, 0) AS dt FROM clock),
vol AS (SELECT listing, rx, sum(CASE WHEN aggressor = 'Bid' THEN qty ELSE -qty END) AS signed, sum(qty) AS total, sum(CASE WHEN aggressor = 'Bid' THEN 1.0::DOUBLE ELSE -1 END) AS net FROM trade WHERE prc > 0 AND qty > 0 GROUP BY ALL),
eps AS (SELECT listing, rx, sign(net)::DOUBLE AS eps FROM vol WHERE net <> 0),
per AS (SELECT * FROM (SELECT listing, rx, eps * lag(eps) OVER (PARTITION BY listing ORDER BY rx) AS per FROM eps) WHERE per IS NOT NULL),
prem AS (SELECT listing, rx, ((bid_qty * ask_prc + ask_qty * bid_prc) / greatest(bid_qty + ask_qty, 1e-30) - (bid_prc + ask_prc) / 2) / ((bid_prc + ask_prc) / 2) AS prem, (bid_qty - ask_qty) / (bid_qty + ask_qty) AS qi
  FROM (SELECT *, row_number() OVER (PARTITION BY listing, rx ORDER BY seq DESC) AS i FROM book) WHERE i = 1),
prev AS (SELECT *, lag(bid_prc) OVER w AS pb, lag(bid_qty) OVER w AS pbq, lag(ask_prc) OVER w AS pa, lag(ask_qty) OVER w AS paq FROM book WINDOW w AS (PARTITION BY listing ORDER BY rx, seq)),
ofi AS (SELECT listing, rx, sum((CASE WHEN bid_prc >= pb THEN bid_qty ELSE 0 END) - (CASE WHEN bid_prc <= pb THEN pbq ELSE 0 END) - (CASE WHEN ask_prc <= pa THEN ask_qty ELSE 0 END) + (CASE WHEN ask_prc >= pa THEN paq ELSE 0 END)) AS ofi
  FROM prev WHERE pb IS NOT NULL GROUP BY ALL)
"""


def sql(select: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([BASE.strip(), *(c.strip() for c in ctes)]) + "\n" + select


def alpha(span: float) -> float:
    return 2.0 / (span + 1.0)


def kern(name: str, src: str, span: float, reads: str = "rd", **values: str) -> str:
    """CTE name (listing, t, c, values): kernel flows of src (listing, rx, ...)."""
    a, d = repr(alpha(span)), repr(1.0 - alpha(span))
    sums = ", ".join(f"sum(({v}) * pow({d}::DOUBLE, -k)) OVER (PARTITION BY listing ORDER BY rx) AS {n}" for n, v in values.items())
    outs = ", ".join(f"{a}::DOUBLE * pow({d}::DOUBLE, r.c) * coalesce(p.{n}, 0) AS {n}" for n in values)
    return f"""{name}_p AS (SELECT listing, rx, {sums} FROM (SELECT s.*, coalesce(c.n, 0) AS k FROM {src} s ASOF LEFT JOIN clock c ON s.rx > c.rx)),
{name} AS (SELECT r.listing, r.t, r.c, {outs} FROM {reads} r ASOF LEFT JOIN {name}_p p ON r.listing = p.listing AND r.t >= p.rx)"""


def ewm(name: str, src: str, span: float, key: str = "listing", **values: str) -> str:
    """CTE name: src (key, n, ...) with plain averages."""
    a, d = repr(alpha(span)), repr(1.0 - alpha(span))
    part = f"PARTITION BY {key}" if key else ""
    outs = ", ".join(f"{a}::DOUBLE * pow({d}::DOUBLE, n) * sum(({v}) * pow({d}::DOUBLE, -n)) OVER ({part} ORDER BY n) AS {n}" for n, v in values.items())
    return f"{name} AS (SELECT *, {outs} FROM {src})"


def ticks(name: str, src: str, *values: str, clip: bool = False) -> str:
    """CTE name (listing, n, t, values): levels at ticks."""
    fill = {v: f"(SELECT arg_min({v}, rx) FROM {src} f WHERE f.listing = l.listing)" if clip else "0" for v in values}
    outs = ", ".join(f"coalesce(s.{v}, {fill[v]}) AS {v}" for v in values)
    return f"{name} AS (SELECT l.listing, l.n, l.rx AS t, {outs} FROM (SELECT * FROM clock CROSS JOIN ls) l ASOF LEFT JOIN {src} s ON l.listing = s.listing AND l.rx >= s.rx)"


def fresh(name: str, src: str, *values: str, clip: bool = False, reads: str = "rd") -> str:
    fill = {v: f"(SELECT arg_min({v}, rx) FROM {src} f WHERE f.listing = l.listing)" if clip else "NULL" for v in values}
    outs = ", ".join(f"coalesce(s.{v}, {fill[v]}) AS {v}" for v in values)
    return f"{name} AS (SELECT l.listing, l.t, l.c, {outs} FROM {reads} l ASOF LEFT JOIN {src} s ON l.listing = s.listing AND l.t >= s.rx)"


def front(name: str, src: str, value: str, span: float, clip: bool = False) -> str:
    """CTE name (listing, t, v): live front of a level."""
    a = repr(alpha(span))
    return ",\n".join([
        ticks(f"{name}_t", src, value, clip=clip), ewm(f"{name}_e", f"{name}_t", span, y=value), fresh(f"{name}_f", src, value, clip=clip),
        f"{name} AS (SELECT f.listing, f.t, (1 - {a}::DOUBLE) * e.y + {a}::DOUBLE * f.{value} AS v FROM {name}_f f JOIN {name}_e e ON e.listing = f.listing AND e.n = f.c)",
    ])


def inject(name: str, src: str, **sums: str) -> str:
    """CTE name (listing, n, sums): mass of each tick."""
    per = ", ".join(f"sum({v}) AS {n}" for n, v in sums.items())
    outs = ", ".join(f"coalesce(p.{n}, 0) AS {n}" for n in sums)
    return f"{name} AS (SELECT l.listing, l.n, {outs} FROM (SELECT * FROM clock CROSS JOIN ls) l LEFT JOIN (SELECT listing, rx, {per} FROM {src} GROUP BY ALL) p ON p.listing = l.listing AND p.rx = l.rx)"


def sigma(name: str, span: float) -> str:
    return kern(f"{name}_k", "moves", span, e="d * d", w="1.0::DOUBLE") + f",\n{name} AS (SELECT listing, t, CASE WHEN w > 0 THEN sqrt(e / w) END AS v FROM {name}_k)"


def lam(name: str, span: float) -> str:
    return kern(f"{name}_k", "moves", span, w="1.0::DOUBLE") + ",\n" + ewm(f"{name}_d", "gaps", span, key="", y="dt") + f",\n{name} AS (SELECT k.listing, k.t, CASE WHEN y > 0 THEN w / y END AS v FROM {name}_k k JOIN {name}_d d ON d.n = k.c)"


def mean(name: str, src: str, span: float, num: str, den: str = "1.0::DOUBLE") -> str:
    return kern(f"{name}_k", src, span, e=num, w=den) + f",\n{name} AS (SELECT listing, t, CASE WHEN w > 0 THEN e / w END AS v FROM {name}_k)"


def committed_mean(name: str, src: str, span: float, num: str, den: str = "1.0::DOUBLE") -> str:
    return ",\n".join([
        inject(f"{name}_i", src, xe=num, xw=den), ewm(f"{name}_e", f"{name}_i", span, e="xe", w="xw"),
        f"{name} AS (SELECT r.listing, r.t, CASE WHEN w > 0 THEN e / w END AS v FROM rd r JOIN {name}_e e ON e.listing = r.listing AND e.n = r.c)",
    ])


def value(src: str, where: str = "true", digits: int = 6) -> str:
    return f"SELECT listing, t, round(v, {digits}) + 0.0::DOUBLE AS value FROM ({src}) WHERE {where}"


def pair(a: str, b: str, expr: str) -> str:
    return f"SELECT a.listing, a.t, {expr} AS v FROM {a} a JOIN {b} b ON a.listing = b.listing AND a.t = b.t"
