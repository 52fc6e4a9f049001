"""DuckDB oracle SQL for the driver queries.

Each string runs in DuckDB over the driver's pre-registered tables; the
``fx_*`` relations are inlined as CTEs (``fixtures.oracle_prelude``). The
SQL is written independently of the Spark plans: matching is a plain nested
loop over requests x merchants with correlated ``EXISTS`` for items, i.e. the
brute force the factored Spark plan must agree with.
"""

from __future__ import annotations

from dealgrid.functions.pricing import AMOUNT_SPREAD, APPROX_PATTERN, BUDGET_WORDS
from dealgrid.functions.text import PY_NUM_WS, PY_WS
from dealgrid.sources.fixtures import oracle_prelude

_DIGITS = r"\d(?:_?\d)*"
_DEC = rf"(?i)^{PY_NUM_WS}*[+-]?({_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(e[+-]?{_DIGITS})?{PY_NUM_WS}*$"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{PY_WS}+|{PY_WS}+$', '', 'g')"


def _pyfloat(x: str) -> str:
    """Python float() of a text expression in DuckDB; NULL where it raises."""
    return (
        f"(CASE WHEN regexp_matches({x}, '{_DEC}') THEN TRY_CAST(replace({_strip(x)}, '_', '') AS DOUBLE)"
        f" WHEN regexp_matches({x}, '(?i)^{PY_NUM_WS}*[+-]?nan{PY_NUM_WS}*$') THEN 'nan'::DOUBLE"
        f" WHEN regexp_matches({x}, '(?i)^{PY_NUM_WS}*-(inf|infinity){PY_NUM_WS}*$') THEN '-inf'::DOUBLE"
        f" WHEN regexp_matches({x}, '(?i)^{PY_NUM_WS}*[+]?(inf|infinity){PY_NUM_WS}*$') THEN 'inf'::DOUBLE END)"
    )


def _max0(x: str) -> str:
    return f"(CASE WHEN NOT isnan({x}) AND {x} > 0 THEN {x} ELSE 0e0 END)"


_APPROX = APPROX_PATTERN.replace(r"\s", PY_WS)


def _number(x: float) -> str:
    return "'inf'::DOUBLE" if x == float("inf") else f"{x!r}::DOUBLE"


def price_bounds_ctes(source: str, key: str, text: str) -> str:
    """CTEs ``pb0..pb2`` and ``bounds(key, lo, hi)`` over ``source``."""
    inf = "'inf'::DOUBLE"
    rules = [
        ("raw IS NULL OR raw = ''", "0e0", inf),
        (
            "(contains(s, 'around') OR contains(s, 'about')) AND approx IS NOT NULL",
            _max0(f"approx - {AMOUNT_SPREAD}"),
            f"approx + {AMOUNT_SPREAD}",
        ),
        *[(f"s = '{word}'", _number(lo), _number(hi)) for word, (lo, hi) in BUDGET_WORDS.items()],
        ("contains(s, 'under $') AND under_v IS NOT NULL", "0e0", "under_v"),
        ("contains(s, 'under $')", "0e0", inf),
        ("contains(s, '$') AND first_v IS NULL", "0e0", inf),
        ("contains(s, '$') AND NOT has_second", "first_v", inf),
        ("contains(s, '$') AND second_v IS NULL", "0e0", inf),
        ("contains(s, '$')", "first_v", "second_v"),
        ("plain IS NOT NULL", _max0(f"plain - {AMOUNT_SPREAD}"), f"plain + {AMOUNT_SPREAD}"),
    ]
    lo = "CASE " + " ".join(f"WHEN {c} THEN {l}" for c, l, _ in rules) + " ELSE 0e0 END"
    hi = "CASE " + " ".join(f"WHEN {c} THEN {h}" for c, _, h in rules) + f" ELSE {inf} END"
    return f"""
pb0 AS (SELECT {key} AS bkey, {text} AS raw,
  {_strip(f"replace(lower({text}), 'sgd', '')")} AS s FROM {source}),
pb1 AS (SELECT *,
  coalesce(nullif(regexp_extract(s, '{_APPROX}', 1), ''),
           nullif(regexp_extract(s, '{_APPROX}', 2), '')) AS approx_txt,
  replace(s, 'under $', '') AS under_txt,
  string_split(replace(s, '$', ''), '-') AS parts FROM pb0),
pb2 AS (SELECT *, {_pyfloat('approx_txt')} AS approx, {_pyfloat('under_txt')} AS under_v,
  {_pyfloat('parts[1]')} AS first_v,
  (len(parts) > 1 AND {_strip('parts[2]')} <> '') AS has_second,
  {_pyfloat('parts[2]')} AS second_v, {_pyfloat('s')} AS plain FROM pb1),
bounds AS (SELECT bkey, ({lo}) AS lo, ({hi}) AS hi FROM pb2)"""


_ITEMS_DP = """
it AS (SELECT merchant_id, pos, name, price, discount_percent,
  lower(coalesce(name, '')) AS iname,
  CASE WHEN price IS NOT NULL AND (isnan(price) OR price >= 0)
       THEN price * (1 - (CASE WHEN isnan(d) THEN d WHEN d >= 0 AND d <= 100 THEN d
                              ELSE 0e0 END) / 100) END AS dp
  FROM (SELECT *, coalesce(discount_percent, 0e0) AS d FROM fx_items) x)"""

_MERCHANTS = """
m AS (SELECT merchant_id, pos, rating, lat, lon,
  lower(coalesce(category, '')) AS mc, lower(coalesce(primary_category, '')) AS pc
  FROM fx_merchants)"""


def _kw(col: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


def match_ctes(
    requests_cte: str,
    extra_views: tuple[str, ...] = (),
    intents: str = "fx_intents",
    intents_ctes: str = "",
    own_bounds: str = "",
) -> str:
    """``WITH`` list ending in ``ranked(request_id, merchant_id, pos, dist,
    score, rn)``. ``requests_cte`` defines ``rq(request_id, customer_id,
    intent_id)``; ``intents`` names the relation with the flat intent columns
    of ``fx_intents`` (``intents_ctes`` defines it when it is not a view);
    ``own_bounds`` is a column that is true where it holds ``lo`` and ``hi`` itself."""
    from dealgrid.operators.match import (
        COUPLE_KEYWORDS, FAMILY_KEYWORDS, MOTHER_KEYWORDS, SPORT_KEYWORDS,
    )

    mother = f"({_kw('pc', MOTHER_KEYWORDS)} OR {_kw('mc', MOTHER_KEYWORDS)})"
    c1 = "(category <> 'general' AND contains(pc, lower(category)))"
    c2 = f"(category <> 'general' AND NOT {c1} AND contains(mc, lower(category)))"
    c3 = (
        f"(category <> 'general' AND NOT {c1} AND NOT {c2} AND category = 'gifts' "
        f"AND lower(coalesce(recipient, '')) = 'mother' AND {mother})"
    )
    r1 = "(coalesce(is_generic, false) OR coalesce(is_ambiguous, false) OR coalesce(confidence = 'low', false))"
    cuisine = "lower(coalesce(cuisine, ''))"
    atmos = "lower(coalesce(atmosphere, ''))"
    partic = "lower(coalesce(participants, ''))"
    atype = "lower(coalesce(activity_type, ''))"
    base = f"""(CASE WHEN {c1} THEN 2 WHEN {c2} THEN 1 WHEN {c3} THEN 2 ELSE 0 END
 + CASE WHEN exact_items IS NOT NULL THEN 3 ELSE 0 END
 + CASE WHEN category = 'food' AND {cuisine} <> '' AND NOT contains(mc, {cuisine})
        AND NOT contains(pc, {cuisine}) THEN -2 ELSE 0 END
 + CASE WHEN category = 'food' AND {atmos} <> '' AND NOT contains(mc, {atmos}) THEN -1 ELSE 0 END
 + CASE WHEN category = 'activities' AND coalesce(solo, false) AND NOT contains(mc, 'solo')
        AND NOT contains(pc, 'individual') THEN -1 ELSE 0 END
 + CASE WHEN category = 'activities' AND {atype} = 'sports'
        AND NOT {_kw('mc', SPORT_KEYWORDS)} THEN -2 ELSE 0 END
 + CASE WHEN category = 'activities' AND {partic} = 'couple'
        AND NOT {_kw('mc', COUPLE_KEYWORDS)} THEN -2
        WHEN category = 'activities' AND {partic} = 'family'
        AND NOT ({_kw('mc', FAMILY_KEYWORDS)} OR {_kw('pc', FAMILY_KEYWORDS)}) THEN -2 ELSE 0 END
 + CASE WHEN {r1} AND preferences IS NOT NULL AND exact_items IS NULL
        AND EXISTS (SELECT 1 FROM unnest(string_split(preferences, '|')) AS u(p)
                    WHERE contains(mc, u.p) OR contains(pc, u.p)) THEN 1 ELSE 0 END)"""
    return (
        oracle_prelude("fx_gazetteer", "fx_merchants", "fx_items", "fx_customers",
                       "fx_intents", "fx_requests", *extra_views)
        + f""",
{intents_ctes}{requests_cte},
{price_bounds_ctes(intents, 'intent_id', 'price_range')},
{_ITEMS_DP},
{_MERCHANTS},
req AS (
  SELECT r.request_id, i.* {"EXCLUDE (lo, hi)" if own_bounds else ""},
    {f"CASE WHEN i.{own_bounds} THEN i.lo ELSE b.lo END" if own_bounds else "b.lo"} AS lo,
    {f"CASE WHEN i.{own_bounds} THEN i.hi ELSE b.hi END" if own_bounds else "b.hi"} AS hi,
    coalesce(g.lat, 1.29e0) AS plat, coalesce(g.lon, 103.85e0) AS plon
  FROM rq r
  JOIN fx_customers c ON r.customer_id = c.consumer_id
  LEFT JOIN fx_gazetteer g ON g.district = lower(c.district)
  JOIN {intents} i ON i.intent_id = r.intent_id
  JOIN bounds b ON b.bkey = i.intent_id
  WHERE i.category IS NOT NULL),
pairs AS (
  SELECT q.*, m.merchant_id, m.pos, m.rating, m.mc, m.pc,
    CASE WHEN q.proximity_km IS NOT NULL THEN
      6371e0 * 2 * atan2(sqrt(a), sqrt(greatest(0e0, 1 - a))) END AS dist
  FROM req q CROSS JOIN m,
  LATERAL (SELECT
      sin(radians(m.lat - q.plat) / 2) * sin(radians(m.lat - q.plat) / 2)
      + cos(radians(q.plat)) * cos(radians(m.lat))
        * (sin(radians(m.lon - q.plon) / 2) * sin(radians(m.lon - q.plon) / 2)) AS a) h),
kept AS (
  SELECT request_id, merchant_id, pos, dist,
    {base} * 1e0 + CASE WHEN dist IS NOT NULL THEN {_max0('5e0 / (dist + 1)')} ELSE 0e0 END AS score
  FROM pairs
  WHERE (proximity_km IS NULL OR dist IS NULL OR isnan(dist) OR dist <= proximity_km)
    AND NOT (min_rating IS NOT NULL AND min_rating <> 0 AND NOT isnan(min_rating)
             AND rating IS NOT NULL AND NOT isnan(rating) AND rating < min_rating)
    AND EXISTS (SELECT 1 FROM it WHERE it.merchant_id = pairs.merchant_id
                AND it.dp IS NOT NULL AND NOT isnan(it.dp) AND NOT isnan(lo) AND NOT isnan(hi)
                AND it.dp >= lo AND it.dp <= hi)
    AND (category = 'general' OR {c1} OR {c2} OR {c3})
    AND NOT EXISTS (SELECT 1 FROM unnest(string_split(exact_items, '|')) AS u(t)
                    WHERE NOT EXISTS (SELECT 1 FROM it WHERE it.merchant_id = pairs.merchant_id
                                      AND contains(it.iname, lower(u.t))))),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY request_id
                               ORDER BY round(score, 6) DESC, pos) AS rn
  FROM kept WHERE score > 0)
"""
    )


def match_sql(requests_cte: str, k: int = 10) -> str:
    return match_ctes(requests_cte) + f"""
SELECT CAST(request_id AS BIGINT) AS request_id, CAST(rn AS BIGINT) AS rank,
  CAST(merchant_id AS BIGINT) AS merchant_id, round(dist, 6) AS dist_km,
  round(score, 6) AS score
FROM ranked WHERE rn <= {k}"""


ALL_REQUESTS = "rq AS (SELECT request_id, customer_id, intent_id FROM fx_requests)"
FOOD_NEARBY_REQUESTS = (
    "rq AS (SELECT consumer_id AS request_id, consumer_id AS customer_id, "
    "0 AS intent_id FROM fx_customers)"
)




def _with(*views: str) -> str:
    return oracle_prelude(*views)


_R1 = (
    "(coalesce(i.is_generic, false) OR coalesce(i.is_ambiguous, false) "
    "OR coalesce(i.confidence = 'low', false))"
)


def nearby_merchants_sql() -> str:
    return _with("fx_customers", "fx_merchants") + """,
points AS (
  SELECT consumer_id AS customer_id, 1.2e0 + (consumer_id * 37 % 1009) / 4000e0 AS plat,
    103.6e0 + (consumer_id * 91 % 1013) / 2500e0 AS plon, 0.5e0 + consumer_id % 7 AS radius_km
  FROM fx_customers),
halves AS (
  SELECT p.*, m.merchant_id,
    pow(sin(radians(m.lat - p.plat) / 2), 2)
      + cos(radians(p.plat)) * cos(radians(m.lat)) * pow(sin(radians(m.lon - p.plon) / 2), 2) AS a
  FROM points p, fx_merchants m),
near AS (
  SELECT *, round(6371e0 * 2 * atan2(sqrt(a), sqrt(greatest(0e0, 1 - a))), 6) AS km FROM halves
  WHERE 6371e0 * 2 * atan2(sqrt(a), sqrt(greatest(0e0, 1 - a))) <= radius_km)
SELECT customer_id::BIGINT AS customer_id, count(*)::BIGINT AS n_near,
  arg_min(merchant_id, (km, merchant_id))::BIGINT AS nearest_id, min(km) AS nearest_km
FROM near GROUP BY customer_id"""


def price_range_sql() -> str:
    return (
        _with("fx_intents", "fx_requests")
        + ","
        + price_bounds_ctes("fx_intents", "intent_id", "price_range")
        + """
SELECT CAST(r.request_id AS BIGINT) AS request_id, b.lo AS price_lo,
  CASE WHEN b.hi <> 'inf'::DOUBLE THEN b.hi END AS price_hi,
  (b.hi <> 'inf'::DOUBLE) AS has_upper
FROM fx_requests r JOIN bounds b ON b.bkey = r.intent_id"""
    )


def exact_items_sql() -> str:
    return _with("fx_items", "fx_intents", "fx_requests") + """,
mi AS (SELECT DISTINCT merchant_id FROM fx_items),
per_intent AS (
  SELECT i.intent_id, (SELECT count(*) FROM mi WHERE NOT EXISTS (
      SELECT 1 FROM unnest(string_split(i.exact_items, '|')) AS u(t)
      WHERE NOT EXISTS (SELECT 1 FROM fx_items it WHERE it.merchant_id = mi.merchant_id
                        AND contains(lower(coalesce(it.name, '')), lower(u.t))))) AS n
  FROM fx_intents i WHERE i.exact_items IS NOT NULL)
SELECT CAST(r.request_id AS BIGINT) AS request_id, CAST(p.n AS BIGINT) AS n_merchants
FROM fx_requests r JOIN per_intent p ON p.intent_id = r.intent_id"""


def preferences_sql() -> str:
    return _with("fx_merchants", "fx_intents", "fx_requests") + f""",
mm AS (SELECT lower(coalesce(category, '')) AS mc,
              lower(coalesce(primary_category, '')) AS pc FROM fx_merchants),
per_intent AS (
  SELECT i.intent_id, (SELECT count(*) FROM mm WHERE EXISTS (
      SELECT 1 FROM unnest(string_split(i.preferences, '|')) AS u(p)
      WHERE contains(mm.mc, u.p) OR contains(mm.pc, u.p))) AS n
  FROM fx_intents i
  WHERE {_R1} AND i.preferences IS NOT NULL AND i.exact_items IS NULL)
SELECT CAST(r.request_id AS BIGINT) AS request_id, CAST(p.n AS BIGINT) AS n_boosted
FROM fx_requests r JOIN per_intent p ON p.intent_id = r.intent_id"""


def _offer_ctes() -> str:
    """``st``: per request customer status, offers and the offer text."""
    from dealgrid.operators.render import (
        MSG_CUSTOMER_NOT_FOUND, MSG_ERROR, MSG_NO_MATCH, MSG_NO_TEXT, MSG_QUARANTINED,
    )

    text = _strip("coalesce(x.content, '')")
    return f""",
offers AS (SELECT request_id, count(*) AS n, arg_min(merchant_id, rn) AS top,
             '[' || string_agg(CAST(merchant_id AS VARCHAR), ', ' ORDER BY rn) || ']' AS ids
           FROM ranked WHERE rn <= 10 GROUP BY request_id),
st0 AS (
  SELECT r.request_id, r.customer_id, coalesce(o.n, 0) AS n, o.top, coalesce(o.ids, '[]') AS ids, i.*,
    CASE WHEN c.consumer_id IS NULL THEN 'customer_not_found'
         WHEN i.category IS NULL THEN 'invalid_category' ELSE 'ok' END AS base_status,
    {text} AS said, x.error
  FROM fx_requests r
  LEFT JOIN fx_customers c ON r.customer_id = c.consumer_id
  JOIN fx_intents i ON i.intent_id = r.intent_id
  LEFT JOIN fx_offer_responses x ON x.request_id = r.request_id
  LEFT JOIN offers o ON o.request_id = r.request_id),
st AS (SELECT *,
  CASE WHEN base_status = 'customer_not_found' THEN '{MSG_CUSTOMER_NOT_FOUND}'
       WHEN base_status <> 'ok' THEN '{MSG_QUARANTINED} (' || base_status || ').'
       WHEN n = 0 THEN '{MSG_NO_MATCH}'
       WHEN error IS NOT NULL THEN '{MSG_ERROR}: ' || error
       WHEN said = '' THEN '{MSG_NO_TEXT}' ELSE said END AS offer_text
  FROM st0)"""


def outcomes_sql() -> str:
    return match_ctes(ALL_REQUESTS, ("fx_offer_responses",)) + _offer_ctes() + """
SELECT CAST(request_id AS BIGINT) AS request_id,
  CASE WHEN base_status <> 'ok' THEN base_status
       WHEN n = 0 THEN 'no_match' ELSE 'matched' END AS status,
  CAST(n AS BIGINT) AS n_offers, CAST(top AS BIGINT) AS top_merchant_id, offer_text,
  CASE WHEN base_status <> 'customer_not_found' THEN category END AS category,
  CASE WHEN base_status <> 'customer_not_found' THEN confidence END AS confidence
FROM st"""


def unknown_customers_sql() -> str:
    return _with("fx_customers", "fx_requests") + """
SELECT CAST(r.request_id AS BIGINT) AS request_id, CAST(r.customer_id AS BIGINT) AS customer_id
FROM fx_requests r
WHERE NOT EXISTS (SELECT 1 FROM fx_customers c WHERE c.consumer_id = r.customer_id)"""


_COUNTS = """
dec AS (SELECT CASE WHEN json_valid(recommended_merchants)
                    THEN CAST(recommended_merchants AS JSON) END AS j FROM fx_log),
el AS (SELECT unnest(
         CASE WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[*]')
              WHEN j IS NULL OR json_type(j) IN ('NULL', 'OBJECT') THEN CAST([] AS JSON[])
              ELSE [j] END) AS e FROM dec),
keyed AS (
  SELECT CASE json_type(e) WHEN 'VARCHAR' THEN 'text'
           WHEN 'BIGINT' THEN 'number' WHEN 'UBIGINT' THEN 'number'
           WHEN 'DOUBLE' THEN 'number' WHEN 'BOOLEAN' THEN 'number' END AS key_kind,
    CASE json_type(e) WHEN 'VARCHAR' THEN json_extract_string(e, '$')
           WHEN 'BOOLEAN' THEN CASE WHEN CAST(e AS BOOLEAN) THEN '1' ELSE '0' END
           WHEN 'DOUBLE' THEN CASE WHEN CAST(e AS DOUBLE) = floor(CAST(e AS DOUBLE))
                                   THEN CAST(CAST(CAST(e AS DOUBLE) AS BIGINT) AS VARCHAR)
                                   ELSE CAST(CAST(e AS DOUBLE) AS VARCHAR) END
           ELSE CAST(CAST(e AS BIGINT) AS VARCHAR) END AS merchant_key
  FROM el),
cnt AS (SELECT merchant_key, key_kind, count(*) AS exposure FROM keyed
        WHERE key_kind IS NOT NULL GROUP BY merchant_key, key_kind)"""


def exposure_counts_sql() -> str:
    return _with("fx_log") + "," + _COUNTS + "\nSELECT merchant_key, key_kind, exposure FROM cnt"


def leaderboard_ranked_sql() -> str:
    return f"""SELECT *, row_number() OVER (ORDER BY exposure DESC, key_kind, merchant_key) AS place
FROM ({leaderboard_sql()})"""


def leaderboard_sql() -> str:
    return _with("fx_log", "fx_merchants") + "," + _COUNTS + """,
mm AS (SELECT 'number' AS key_kind, CAST(merchant_id AS VARCHAR) AS merchant_key,
              name, primary_category, rating, district FROM fx_merchants)
SELECT c.merchant_key, c.key_kind,
  CASE WHEN m.key_kind IS NULL THEN 'Unknown' ELSE m.name END AS name,
  CASE WHEN m.key_kind IS NULL THEN 'N/A' ELSE m.primary_category END AS primary_category,
  CASE WHEN m.key_kind IS NULL THEN 'N/A' ELSE CAST(m.rating AS VARCHAR) END AS rating,
  CASE WHEN m.key_kind IS NULL THEN 'N/A' ELSE m.district END AS district,
  CAST(c.exposure AS BIGINT) AS exposure
FROM cnt c LEFT JOIN mm m ON m.key_kind = c.key_kind AND m.merchant_key = c.merchant_key"""


def distinct_preferences_sql() -> str:
    return _with("fx_intents", "fx_requests") + f"""
SELECT DISTINCT CAST(r.request_id AS BIGINT) AS request_id, u.p AS preference
FROM fx_requests r JOIN fx_intents i ON i.intent_id = r.intent_id,
     unnest(string_split(i.preferences, '|')) AS u(p)
WHERE {_R1}"""


_DECODED = r"""
t AS (SELECT request_id, step,
        regexp_replace(coalesce(content, ''), '^""" + PY_WS + "+|" + PY_WS + r"""+$', '', 'g') AS txt FROM fx_responses),
d AS (SELECT request_id, step,
        CASE WHEN txt = '' THEN 'empty' WHEN json_valid(txt) THEN 'strict'
             WHEN json_valid(regexp_extract(txt, '(?s)\{.*\}', 0)) THEN 'span'
             ELSE 'none' END AS how,
        CASE WHEN txt = '' THEN NULL WHEN json_valid(txt) THEN txt
             WHEN json_valid(regexp_extract(txt, '(?s)\{.*\}', 0))
             THEN regexp_extract(txt, '(?s)\{.*\}', 0) END AS jtxt
      FROM t)"""


def _jtext(j: str, field: str) -> str:
    return (
        f"CASE WHEN json_type(CAST({j} AS JSON), '$.{field}') = 'VARCHAR' "
        f"THEN json_extract_string(CAST({j} AS JSON), '$.{field}') END"
    )


def _truthy(j: str) -> str:
    x = f"CAST({j} AS JSON)"
    return f"""(CASE WHEN {j} IS NULL THEN false
  WHEN json_type({x}) = 'NULL' THEN false
  WHEN json_type({x}) = 'BOOLEAN' THEN CAST({x} AS BOOLEAN)
  WHEN json_type({x}) IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST({x} AS DOUBLE) <> 0
  WHEN json_type({x}) = 'VARCHAR' THEN json_extract_string({x}, '$') <> ''
  WHEN json_type({x}) = 'ARRAY' THEN json_array_length({x}) > 0
  WHEN json_type({x}) = 'OBJECT' THEN len(json_keys({x})) > 0
  ELSE false END)"""


def intent_decode_sql() -> str:
    return _with("fx_responses") + "," + _DECODED + f"""
SELECT CAST(request_id AS BIGINT) AS request_id, CAST(step AS BIGINT) AS step, how,
  {_jtext('jtxt', 'category')} AS category, {_jtext('jtxt', 'confidence')} AS confidence
FROM d"""


_RESOLVED = f""",
w AS (SELECT request_id,
        max(CASE WHEN step = 1 THEN jtxt END) AS j1,
        max(CASE WHEN step = 2 THEN jtxt END) AS j2
      FROM d GROUP BY request_id),
f AS (SELECT request_id, {_truthy('j1')} AS ok1, {_truthy('j2')} AS ok2, j1, j2 FROM w)"""


def intent_resolve_sql() -> str:
    return _with("fx_responses") + "," + _DECODED + _RESOLVED + f"""
SELECT CAST(request_id AS BIGINT) AS request_id,
  CASE WHEN ok2 THEN 'refined' WHEN ok1 THEN 'initial' ELSE 'default' END AS source,
  CASE WHEN ok2 THEN {_jtext('j2', 'category')} WHEN ok1 THEN {_jtext('j1', 'category')}
       ELSE 'general' END AS category,
  CASE WHEN ok2 THEN {_jtext('j2', 'confidence')} WHEN ok1 THEN {_jtext('j1', 'confidence')}
       ELSE 'low' END AS confidence
FROM f"""


def _jfield_text(j: str, path: str) -> str:
    x = f"CAST({j} AS JSON)"
    return (
        f"CASE WHEN json_type({x}, '{path}') IS NULL OR json_type({x}, '{path}') = 'NULL' "
        f"THEN '' WHEN json_type({x}, '{path}') = 'VARCHAR' "
        f"THEN json_extract_string({x}, '{path}') END"
    )


def _jfield_number(j: str, path: str) -> str:
    x = f"CAST({j} AS JSON)"
    return (
        f"CASE WHEN json_type({x}, '{path}') IN ('BIGINT', 'UBIGINT', 'DOUBLE') "
        f"THEN CAST(json_extract({x}, '{path}') AS DOUBLE) END"
    )


def _jfield_truthy(j: str, path: str) -> str:
    return _truthy(f"json_extract(CAST({j} AS JSON), '{path}')")


def _response_intents() -> str:
    """CTEs up to ``ri``: the flat intent each request's responses resolve to, with its
    ``status`` and, where the budget is an object, ``lo`` and ``hi``. Written from the
    source application's reading of each field."""
    from dealgrid.operators.decode import DEFAULT_INTENT_JSON

    j = "CAST(j AS JSON)"
    num = "('BIGINT', 'UBIGINT', 'DOUBLE')"

    def kind(path: str) -> str:
        return f"json_type({j}, '{path}')"

    def bound(name: str, default: str) -> str:
        path = f"$.price_range.{name}"
        return (
            f"CASE WHEN {kind(path)} IS NULL THEN {default} "
            f"WHEN {kind(path)} IN {num} THEN CAST(json_extract({j}, '{path}') AS DOUBLE) "
            f"WHEN {kind(path)} = 'BOOLEAN' THEN CAST(CAST(json_extract({j}, '{path}') AS BOOLEAN) AS DOUBLE) "
            f"WHEN {kind(path)} = 'VARCHAR' THEN {_pyfloat(f"json_extract_string({j}, '{path}')")} END"
        )

    texts = ("recipient", "cuisine", "atmosphere", "participants", "type")
    fields = ",\n".join(f"  {_jfield_text('j', '$.specifics.' + n)} AS sp_{n}" for n in texts)
    bad_text = " OR ".join(f"sp_{n} IS NULL" for n in texts)
    price = kind("$.price_range")
    items = kind("$.exact_items")
    return _DECODED.strip() + _RESOLVED + f""",
step3 AS (SELECT request_id, max(content) AS c3 FROM fx_responses WHERE step = 3 GROUP BY request_id),
deduced AS (SELECT request_id, CASE WHEN json_valid(c3) THEN CASE WHEN json_type(CAST(c3 AS JSON)) = 'ARRAY'
     THEN array_to_string(list_transform(list_filter(json_extract(CAST(c3 AS JSON), '$[*]'),
            lambda e: json_type(e) = 'VARCHAR'), lambda e: json_extract_string(e, '$')), '|') END END AS all_prefs
  FROM step3),
res AS (SELECT request_id, CASE WHEN ok2 THEN 'refined' WHEN ok1 THEN 'initial' ELSE 'default' END AS source,
          CASE WHEN ok2 THEN j2 WHEN ok1 THEN j1 ELSE '{DEFAULT_INTENT_JSON}' END AS j FROM f),
raw AS (SELECT res.request_id, source, j, json_type({j}) AS top,
  CASE WHEN {kind('$.category')} IS NULL THEN 'general' WHEN {kind('$.category')} = 'VARCHAR'
       THEN json_extract_string({j}, '$.category') END AS cat,
  {price} AS price_kind,
  {bound('min', '0e0')} AS olo, {bound('max', "'inf'::DOUBLE")} AS ohi,
  {_jfield_truthy('j', '$.price_range')} AS price_given,
  {_jfield_truthy('j', '$.exact_items')} AS items_given, {items} AS items_kind,
  CASE WHEN {items} = 'ARRAY' THEN json_extract({j}, '$.exact_items[*]') END AS item_list,
  {kind('$.specifics')} AS sp_kind,
  {_jfield_truthy('j', '$.specifics.solo')} AS sp_solo,
{fields}
  FROM res),
ri0 AS (SELECT raw.*,
  CASE WHEN top <> 'OBJECT' THEN 'invalid_intent'
       WHEN cat IS NULL THEN 'invalid_category'
       WHEN price_given AND price_kind NOT IN ('VARCHAR', 'OBJECT') THEN 'invalid_price_range'
       WHEN cat IN ('food', 'activities', 'gifts')
            AND (coalesce(sp_kind NOT IN ('OBJECT'), false) OR {bad_text}) THEN 'invalid_specifics'
       WHEN items_given AND (items_kind <> 'ARRAY'
            OR len(list_filter(item_list, lambda e: json_type(e) <> 'VARCHAR')) > 0) THEN 'invalid_exact_items'
       ELSE 'ok' END AS intent_status
  FROM raw),
ri AS (SELECT ri0.request_id AS intent_id, source, intent_status,
  CASE WHEN intent_status = 'ok' THEN cat END AS category,
  CASE WHEN price_kind = 'VARCHAR' THEN json_extract_string({j}, '$.price_range') END AS price_range,
  coalesce(price_kind = 'OBJECT', false) AS by_object,
  CASE WHEN olo IS NULL OR ohi IS NULL THEN 0e0 ELSE olo END AS lo,
  CASE WHEN olo IS NULL OR ohi IS NULL THEN 'inf'::DOUBLE ELSE ohi END AS hi,
  {_jfield_number('j', '$.proximity_km')} AS proximity_km,
  CASE WHEN {_jfield_truthy('j', '$.min_rating')} THEN
    CASE WHEN {kind('$.min_rating')} = 'VARCHAR' THEN {_pyfloat(f"json_extract_string({j}, '$.min_rating')")}
         ELSE {_jfield_number('j', '$.min_rating')} END END AS min_rating,
  CASE WHEN items_given AND items_kind = 'ARRAY' THEN array_to_string(
    list_transform(item_list, lambda e: json_extract_string(e, '$')), '|') END AS exact_items,
  sp_cuisine AS cuisine, sp_atmosphere AS atmosphere, sp_participants AS participants, sp_solo AS solo,
  sp_type AS activity_type, sp_recipient AS recipient,
  {_jfield_truthy('j', '$.is_generic')} AS is_generic,
  {_jfield_truthy('j', '$.is_ambiguous')} AS is_ambiguous,
  CASE WHEN {kind('$.confidence')} IS NULL THEN 'medium' WHEN {kind('$.confidence')} = 'VARCHAR'
       THEN json_extract_string({j}, '$.confidence') END AS confidence,
  nullif(all_prefs, '') AS preferences
FROM ri0 LEFT JOIN deduced ON deduced.request_id = ri0.request_id)"""


def responses_match_sql() -> str:
    """Decoded responses -> flat intents (the columns of fx_intents) -> the
    brute-force match."""
    rq = "rq AS (SELECT request_id, customer_id, request_id AS intent_id FROM fx_requests)"
    return match_ctes(rq, ("fx_responses",), "ri", _response_intents() + ",\n", "by_object") + """
SELECT CAST(request_id AS BIGINT) AS request_id, CAST(rn AS BIGINT) AS rank,
  CAST(merchant_id AS BIGINT) AS merchant_id, round(dist, 6) AS dist_km,
  round(score, 6) AS score
FROM ranked WHERE rn <= 10"""


def intent_status_sql() -> str:
    return (
        _with("fx_responses")
        + ",\n"
        + _response_intents()
        + ",\n"
        + price_bounds_ctes("ri", "intent_id", "price_range")
        + """
SELECT CAST(intent_id AS BIGINT) AS request_id, source, intent_status,
  CASE WHEN intent_status = 'ok' THEN CASE WHEN by_object THEN ri.lo ELSE b.lo END END AS price_lo,
  CASE WHEN intent_status = 'ok' THEN
    nullif(CASE WHEN by_object THEN ri.hi ELSE b.hi END, 'inf'::DOUBLE) END AS price_hi,
  CASE WHEN intent_status = 'ok' THEN proximity_km END AS proximity_km,
  CASE WHEN intent_status = 'ok' THEN min_rating END AS min_rating,
  CASE WHEN intent_status = 'ok'
       THEN CAST(coalesce(len(string_split(exact_items, '|')), 0) AS BIGINT) END AS n_items,
  coalesce(array_to_string(list_distinct_in_order, '|'), '') AS preferences
FROM ri JOIN bounds b ON b.bkey = ri.intent_id,
  LATERAL (SELECT list(p ORDER BY k) AS list_distinct_in_order FROM (
    SELECT u.p AS p, min(u.k) AS k FROM (
      SELECT unnest(string_split(preferences, '|')) AS p, generate_subscripts(string_split(preferences, '|'), 1) AS k
    ) u GROUP BY u.p) d) x"""
    )


def offer_items_raw_sql() -> str:
    number = "('BIGINT', 'UBIGINT', 'DOUBLE')"

    def shown(name: str) -> str:
        return (
            f"CASE WHEN json_type(it, '$.{name}') IS NULL THEN 0e0 "
            f"WHEN json_type(it, '$.{name}') IN {number} THEN CAST(json_extract(it, '$.{name}') AS DOUBLE) "
            f"WHEN json_type(it, '$.{name}') = 'VARCHAR' THEN "
            f"{_pyfloat(f"json_extract_string(it, '$.{name}')")} END"
        )

    return _with("fx_merchant_json") + f""",
r AS (SELECT merchant_id, CAST(value AS JSON) AS v FROM fx_merchant_json),
it AS (SELECT merchant_id, u.i, json_extract(v, '$.items[' || u.i || ']') AS it
       FROM r, unnest(range(0, 3)) AS u(i)),
n AS (SELECT merchant_id, i, coalesce(json_extract_string(it, '$.name'), 'None') AS name,
        {shown('price')} AS price, {shown('discount_percent')} AS d FROM it),
l AS (SELECT merchant_id, count(*) AS c, string_agg('  - ' || name || ': was $' || printf('%.2f', price)
        || ', now $' || printf('%.2f', price * (1 - d / 100)) || ' (' || printf('%.0f', d) || '% off)',
        chr(10) ORDER BY i) AS lines
      FROM n WHERE price IS NOT NULL AND d IS NOT NULL GROUP BY merchant_id)
SELECT CAST(r.merchant_id AS BIGINT) AS merchant_id,
  '- ' || coalesce(json_extract_string(v, '$.name'), 'None') || ' ['
    || coalesce(json_extract_string(v, '$.primary_category'), 'None') || ', rating '
    || coalesce(json_extract_string(v, '$.rating'), 'None') || ']' AS header,
  CAST(coalesce(l.c, 0) AS BIGINT) AS n_lines, coalesce(l.lines, '') AS lines
FROM r LEFT JOIN l ON l.merchant_id = r.merchant_id"""


def leaderboard_raw_sql() -> str:
    def shown(path: str, label: str) -> str:
        return (
            f"CASE WHEN m.v IS NULL OR json_type(m.v, '{path}') IS NULL THEN '{label}' "
            f"ELSE json_extract_string(m.v, '{path}') END"
        )

    return _with("fx_log", "fx_merchant_json") + "," + _COUNTS + f""",
m AS (SELECT CAST(merchant_id AS VARCHAR) AS merchant_key, CAST(value AS JSON) AS v FROM fx_merchant_json)
SELECT c.merchant_key, c.key_kind, {shown('$.name', 'Unknown')} AS name,
  {shown('$.primary_category', 'N/A')} AS primary_category, {shown('$.rating', 'N/A')} AS rating,
  {shown('$.address.district', 'N/A')} AS district, CAST(c.exposure AS BIGINT) AS exposure
FROM cnt c LEFT JOIN m ON c.key_kind = 'number' AND m.merchant_key = c.merchant_key"""


def id_forms_sql() -> str:
    """What int() makes of each form, by hand: text digits (blanks and leading zeros
    allowed) are the number, other text stays text, floats are cut, true is 1."""
    return _with("fx_requests", "fx_customers") + """,
forms AS (
  SELECT request_id, 'text' AS form, CASE WHEN request_id % 5 IN (0, 1) THEN request_id END AS cid FROM fx_requests
  UNION ALL SELECT request_id, 'double', request_id FROM fx_requests
  UNION ALL SELECT request_id, 'boolean', request_id % 2 FROM fx_requests)
SELECT CAST(request_id AS BIGINT) AS request_id, form,
  EXISTS (SELECT 1 FROM fx_customers c WHERE c.consumer_id = forms.cid) AS found
FROM forms"""


def log_id_forms_sql() -> str:
    """Which id each logged form is, by hand."""
    return _with("fx_id_log") + """,
e AS (SELECT log_id % 6 AS form, log_id % 3 AS third FROM fx_id_log),
k AS (
  SELECT 'number' AS key_kind, '1234567890123456789' || CAST(third AS VARCHAR) AS merchant_key, 1 AS n FROM e WHERE form = 0
  UNION ALL SELECT 'text', '7', 1 FROM e WHERE form = 1
  UNION ALL SELECT 'number', '7', 2 FROM e WHERE form = 2
  UNION ALL SELECT 'number', '1', 2 FROM e WHERE form = 3
  UNION ALL SELECT 'number', '1.5', 1 FROM e WHERE form = 4
  UNION ALL SELECT 'number', '10', 2 FROM e WHERE form = 5)
SELECT merchant_key, key_kind, CAST(sum(n) AS BIGINT) AS exposure FROM k GROUP BY merchant_key, key_kind"""


def customer_directory_sql() -> str:
    return _with("fx_customers") + """
SELECT CAST(consumer_id AS BIGINT) AS customer_id,
  CAST(consumer_id AS VARCHAR) || ': ' || coalesce(name, 'None') || ' ('
  || coalesce(CAST(age AS VARCHAR), 'None') || ' ' || coalesce(sex, 'None') || ', '
  || coalesce(district, '') || ', $' || printf('%.0f', coalesce(balance, 0e0)) || ')' AS label
FROM fx_customers"""


def recent_transactions_sql() -> str:
    return _with("fx_customers", "fx_transactions") + """,
t AS (SELECT consumer_id, count(*) AS n,
        '[' || string_agg('(' || CAST(merchant_id AS VARCHAR) || ', '''
                          || category || ''', ' || CAST(amount AS VARCHAR) || ')', ', '
                          ORDER BY pos) || ']' AS txt
      FROM fx_transactions GROUP BY consumer_id)
SELECT CAST(c.consumer_id AS BIGINT) AS customer_id,
  CAST(coalesce(t.n, 0) AS BIGINT) AS n_transactions,
  coalesce(t.txt, '[]') AS transactions_text
FROM fx_customers c LEFT JOIN t ON t.consumer_id = c.consumer_id"""


def offer_items_sql() -> str:
    return match_ctes(ALL_REQUESTS) + """,
top3 AS (SELECT merchant_id, pos, name, price, discount_percent,
           row_number() OVER (PARTITION BY merchant_id ORDER BY pos) AS ipos
         FROM fx_items)
SELECT CAST(k.request_id AS BIGINT) AS request_id, CAST(k.rn AS BIGINT) AS rank,
  CAST(t.pos AS BIGINT) AS item_pos, t.name AS item_name, round(t.price, 6) AS price,
  round(t.discount_percent, 6) AS discount_percent,
  round(t.price * (1 - t.discount_percent / 100), 6) AS discounted_price
FROM ranked k JOIN top3 t ON t.merchant_id = k.merchant_id
WHERE k.rn <= 10 AND t.ipos <= 3 AND t.price IS NOT NULL AND t.discount_percent IS NOT NULL"""


def offer_listing_sql() -> str:
    return match_ctes(ALL_REQUESTS) + """
SELECT CAST(k.request_id AS BIGINT) AS request_id, CAST(k.rn AS BIGINT) AS rank,
  CAST(k.merchant_id AS BIGINT) AS merchant_id,
  'Merchant ' || CAST(k.rn AS VARCHAR) || ': ' || coalesce(f.name, 'None')
    || ' (ID: ' || CAST(k.merchant_id AS VARCHAR) || ')' AS label,
  CASE WHEN k.dist IS NOT NULL THEN printf('%.1f', k.dist) END AS distance_km
FROM ranked k JOIN fx_merchants f ON f.merchant_id = k.merchant_id
WHERE k.rn <= 10"""


_HISTORY = """
hist AS (SELECT log_id, CASE WHEN microsecond(ts) % 1000000 = 0
                     THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
                     ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS log_time,
            customer_id, recommended_merchants FROM fx_log)"""


def _log_sql(hist_ids: str) -> str:
    from dealgrid.plans.queries import BATCH_LOG_TIME

    return match_ctes(ALL_REQUESTS, ("fx_log", "fx_offer_responses")) + _offer_ctes() + f""",
batch AS (SELECT *, {_REQUEST_TEXT} AS rtext,
  CASE WHEN base_status = 'customer_not_found' THEN '{{}}' ELSE {_intent_json(False)} END AS ijson FROM st),
{_HISTORY}
SELECT log_time, CAST(customer_id AS BIGINT) AS customer_id, CAST(NULL AS VARCHAR) AS user_request,
  CAST(NULL AS VARCHAR) AS intent, CAST(NULL AS VARCHAR) AS offer, {hist_ids} AS recommended_merchants
FROM hist
UNION ALL
SELECT '{BATCH_LOG_TIME}', CAST(customer_id AS BIGINT), rtext, ijson, offer_text, ids FROM batch"""


def log_csv_sql() -> str:
    return _with("fx_log") + "," + _HISTORY + """
SELECT log_time, CAST(customer_id AS BIGINT) AS customer_id,
  CASE log_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'plain ' || log_id
    WHEN 2 THEN 'He said "' || log_id || '", twice'
    ELSE 'one' || chr(10) || chr(10) || '"' || log_id || '",' || chr(10) || 'two ' END AS user_request,
  '{"id": ' || log_id || ',' || chr(10) || ' "q": "a, b"}' AS intent,
  CASE WHEN log_id % 2 = 0 THEN NULL WHEN log_id % 5 = 0 THEN '' ELSE 'offer' END AS offer,
  CASE WHEN log_id % 2 = 0 THEN '[]' ELSE recommended_merchants END AS recommended_merchants
FROM hist"""


def log_clear_sql() -> str:
    return _with("fx_log") + """
SELECT 'never written' AS step, CAST(0 AS BIGINT) AS n_rows
UNION ALL SELECT 'appended', count(*) FROM fx_log
UNION ALL SELECT 'cleared', 0
UNION ALL SELECT 'appended again', count(*) FROM fx_log WHERE log_id % 3 = 0"""


def ingest_sql() -> str:
    return _with("fx_merchants", "fx_items") + """
SELECT CAST(m.merchant_id AS BIGINT) AS merchant_id, m.name, m.rating, m.lat, m.lon,
  CAST(coalesce(n.n, 0) AS BIGINT) AS n_items
FROM fx_merchants m
LEFT JOIN (SELECT merchant_id, count(*) AS n FROM fx_items GROUP BY merchant_id) n
  ON n.merchant_id = m.merchant_id"""


def oracle_sql() -> dict[str, str]:
    return {
        "match_food_nearby": match_sql(FOOD_NEARBY_REQUESTS),
        "match_all_intents": match_sql(ALL_REQUESTS),
        "nearby_merchants": nearby_merchants_sql(),
        "price_range_parse": price_range_sql(),
        "match_exact_items": exact_items_sql(),
        "match_preferences": preferences_sql(),
        "request_outcomes": outcomes_sql(),
        "unknown_customers": unknown_customers_sql(),
        "exposure_counts": exposure_counts_sql(),
        "exposure_leaderboard": leaderboard_sql(),
        "leaderboard_ranked": leaderboard_ranked_sql(),
        "distinct_preferences": distinct_preferences_sql(),
        "intent_decode": intent_decode_sql(),
        "intent_resolve": intent_resolve_sql(),
        "customer_directory": customer_directory_sql(),
        "recent_transactions": recent_transactions_sql(),
        "offer_items": offer_items_sql(),
        "offer_listing": offer_listing_sql(),
        "log_union": _log_sql("recommended_merchants"),
        "log_backfill": _log_sql("'[]'"),
        "log_append_history": _log_sql("CASE WHEN log_id % 2 = 0 THEN '[]' ELSE recommended_merchants END"),
        "log_clear": log_clear_sql(),
        "log_csv_history": log_csv_sql(),
        "intent_status": intent_status_sql(),
        "offer_items_raw": offer_items_raw_sql(),
        "leaderboard_raw": leaderboard_raw_sql(),
        "id_forms": id_forms_sql(),
        "log_id_forms": log_id_forms_sql(),
        "jsonl_ingest_dedupe": ingest_sql(),
        "exposure_stream": exposure_counts_sql(),
        "match_from_responses": responses_match_sql(),
        "prompt_table": prompt_table_sql(),
        "request_cycle": request_cycle_sql(),
    }


def _lit(text: str) -> str:
    """A Python string as a DuckDB text expression (newlines via chr(10))."""
    parts = ["'" + p.replace("'", "''") + "'" for p in text.split("\n")]
    return "(" + " || chr(10) || ".join(parts) + ")"


_REQUEST_TEXT = """concat_ws(' ', coalesce(category, 'anything'), coalesce(price_range, ''),
  CASE WHEN proximity_km IS NOT NULL THEN 'within ' || CAST(proximity_km AS VARCHAR) || ' km' END)"""


def _json_text(col: str) -> str:
    return f"coalesce(CAST(to_json({col}) AS VARCHAR), 'null')"


def _intent_json(pretty: bool) -> str:
    """JSON of the intent row, null fields written; nested as a decoded intent is."""
    number = "coalesce(CAST({0} AS VARCHAR), 'null')".format
    flag = "CASE WHEN {0} IS NULL THEN 'null' WHEN {0} THEN 'true' ELSE 'false' END".format
    # lists stay on one line; the pretty form has blanks inside its brackets
    left, right, comma = ("[ ", " ]", ", ") if pretty else ("[", "]", ",")
    items = (
        f"CASE WHEN exact_items IS NULL THEN 'null' ELSE '{left}\"' || "
        f"replace(exact_items, '|', '\"{comma}\"') || '\"{right}' END"
    )
    inner = [(n, _json_text(n)) for n in ("recipient", "cuisine", "atmosphere", "participants")]
    inner += [("solo", flag("solo")), ("type", _json_text("activity_type"))]
    outer = [
        ("category", _json_text("category")), ("exact_items", items),
        ("price_range", _json_text("price_range")), ("proximity_km", number("proximity_km")),
        ("min_rating", number("min_rating")), ("specifics", None),
        ("is_generic", flag("is_generic")), ("is_ambiguous", flag("is_ambiguous")),
        ("confidence", _json_text("confidence")),
    ]

    def block(fields: list[tuple[str, str | None]], depth: int) -> str:
        gap = ": " if pretty else ":"
        start = "chr(10) || '" + "  " * depth if pretty else "'"
        end = "chr(10) || '" + "  " * (depth - 1) if pretty else "'"
        parts = [
            f"{start}\"{name}\"{gap}' || {block(inner, depth + 1) if value is None else f'({value})'}"
            for name, value in fields
        ]
        return "'{' || " + " || ',' || ".join(parts) + f" || {end}}}'"

    return "(" + block(outer, 1) + ")"


def _profile(tx: str) -> str:
    return (
        "'Name: ' || coalesce(name, 'None') || chr(10) || 'Age: ' || "
        "coalesce(CAST(age AS VARCHAR), 'None') || ', Sex: ' || coalesce(sex, 'None') || chr(10) "
        "|| 'Occupation: ' || coalesce(occupation, 'None') || chr(10) || 'Balance: $' || "
        "printf('%.2f', coalesce(balance, 0e0)) || chr(10) || 'Location: ' || "
        f"coalesce(district, 'None') || chr(10) || 'Recent transactions: ' || {tx}"
    )


_TRANSACTIONS = """tx AS (SELECT consumer_id,
         '[' || string_agg('(' || CAST(merchant_id AS VARCHAR) || ', ''' || category || ''', '
                           || CAST(amount AS VARCHAR) || ')', ', ' ORDER BY pos) || ']' AS t_amt,
         '[' || string_agg('(' || CAST(merchant_id AS VARCHAR) || ', ''' || category || ''')',
                           ', ' ORDER BY pos) || ']' AS t_noamt
       FROM fx_transactions GROUP BY consumer_id),
"""

#: Merchant blocks of each request in rank order, from ``ranked``.
_SUMMARIES = """top3 AS (SELECT merchant_id, pos, name, price, discount_percent,
           row_number() OVER (PARTITION BY merchant_id ORDER BY pos) AS ipos
         FROM fx_items),
lines AS (SELECT merchant_id,
            string_agg('  - ' || coalesce(name, 'None') || ': was $' || printf('%.2f', price)
                       || ', now $'
                       || printf('%.2f', price * (1 - discount_percent / 100))
                       || ' (' || printf('%.0f', discount_percent) || '% off)',
                       chr(10) ORDER BY pos) AS l
          FROM top3 WHERE ipos <= 3 AND price IS NOT NULL AND discount_percent IS NOT NULL
          GROUP BY merchant_id),
blocks AS (SELECT k.request_id, k.rn,
             '- ' || coalesce(f.name, 'None') || ' [' || coalesce(f.primary_category, 'None')
             || ', rating ' || coalesce(CAST(f.rating AS VARCHAR), 'None')
             || CASE WHEN k.dist IS NOT NULL THEN ', ' || printf('%.1f', k.dist) || ' km' ELSE '' END
             || ']' || chr(10) || coalesce(ln.l, '') AS block
           FROM ranked k JOIN fx_merchants f ON f.merchant_id = k.merchant_id
           LEFT JOIN lines ln ON ln.merchant_id = k.merchant_id
           WHERE k.rn <= 10),
summ AS (SELECT request_id, string_agg(block, chr(10) ORDER BY rn) AS summary
         FROM blocks GROUP BY request_id)
"""


def prompt_table_sql() -> str:
    from dealgrid.operators.render import (
        EXTRACT_HEAD, OFFER_PARTS, PREFERENCE_PARTS, REFINE_PARTS,
    )

    ra, rb, rc, rd = (_lit(x) for x in REFINE_PARTS)
    pa, pb, pc = (_lit(x) for x in PREFERENCE_PARTS)
    oa, ob, oc, od = (_lit(x) for x in OFFER_PARTS)
    r1 = _R1.replace("i.", "")
    return match_ctes(ALL_REQUESTS, ("fx_transactions",)) + f""",
{_TRANSACTIONS}base AS (SELECT r.request_id, i.*, c.name, c.age, c.sex, c.occupation, c.balance, c.district,
           coalesce(tx.t_amt, '[]') AS t_amt, coalesce(tx.t_noamt, '[]') AS t_noamt
         FROM fx_requests r JOIN fx_intents i ON i.intent_id = r.intent_id
         JOIN fx_customers c ON c.consumer_id = r.customer_id
         LEFT JOIN tx ON tx.consumer_id = c.consumer_id),
txt AS (SELECT request_id, category, {r1} AS r1,
          {_REQUEST_TEXT} AS rtext,
          {_intent_json(True)} AS ijson,
          {_profile('t_amt')} AS prof,
          {_profile('t_noamt')} AS prof_noamt
        FROM base),
{_SUMMARIES}SELECT CAST(request_id AS BIGINT) AS request_id, CAST(1 AS BIGINT) AS step,
  {_lit(EXTRACT_HEAD)} || rtext AS text FROM txt
UNION ALL
SELECT CAST(request_id AS BIGINT), CAST(2 AS BIGINT),
  {ra} || rtext || {rb} || ijson || {rc} || prof || {rd} FROM txt
UNION ALL
SELECT CAST(request_id AS BIGINT), CAST(3 AS BIGINT),
  {pa} || prof || {pb} || coalesce(category, 'general') || {pc} FROM txt WHERE r1
UNION ALL
SELECT CAST(t.request_id AS BIGINT), CAST(4 AS BIGINT),
  {oa} || t.prof_noamt || {ob} || t.ijson || {oc} || s.summary || {od} || t.rtext
FROM txt t JOIN summ s ON s.request_id = t.request_id"""


def _json_by_key(j: str) -> str:
    """The JSON text ``j`` with keys by name, the top ones on a line each."""
    x = f"CAST({j} AS JSON)"
    at = f"json_extract({x}, '$.\"' || k || '\"')"
    nested = (
        f"CASE WHEN json_type({at}) = 'OBJECT' THEN '{{' || array_to_string(['\"' || m || '\":' || "
        f"CAST(json_extract({at}, '$.\"' || m || '\"') AS VARCHAR) FOR m IN list_sort(json_keys({at}))], ',') "
        f"|| '}}' ELSE CAST({at} AS VARCHAR) END"
    )
    return (
        f"CASE WHEN json_type({x}) <> 'OBJECT' THEN {j} WHEN len(json_keys({x})) = 0 THEN '{{}}' "
        f"ELSE '{{' || chr(10) || array_to_string(['  \"' || k || '\":' || ({nested}) "
        f"FOR k IN list_sort(json_keys({x}))], ',' || chr(10)) || chr(10) || '}}' END"
    )


def request_cycle_sql() -> str:
    """Four rounds; the answers of every seventh request come a round late."""
    from dealgrid.operators.decode import DEFAULT_INTENT_JSON
    from dealgrid.operators.render import (
        EXTRACT_HEAD, OFFER_PARTS, PREFERENCE_PARTS, REFINE_PARTS,
    )

    ra, rb, rc, rd = (_lit(x) for x in REFINE_PARTS)
    pa, pb, pc = (_lit(x) for x in PREFERENCE_PARTS)
    oa, ob, oc, od = (_lit(x) for x in OFFER_PARTS)
    rq = "rq AS (SELECT request_id, customer_id, request_id AS intent_id FROM fx_requests)"
    ctes = match_ctes(rq, ("fx_responses", "fx_transactions"), "ri", _response_intents() + ",\n", "by_object")
    return ctes + f""",
{_TRANSACTIONS}base AS (SELECT r.request_id, {_REQUEST_TEXT} AS rtext, {_profile('t_amt')} AS prof,
           {_profile('t_noamt')} AS prof_noamt
         FROM (SELECT q.request_id, c.*, i.category, i.price_range, i.proximity_km,
                 coalesce(tx.t_amt, '[]') AS t_amt, coalesce(tx.t_noamt, '[]') AS t_noamt
               FROM fx_requests q JOIN fx_intents i ON i.intent_id = q.intent_id
               JOIN fx_customers c ON c.consumer_id = q.customer_id
               LEFT JOIN tx ON tx.consumer_id = c.consumer_id) r),
{_SUMMARIES.rstrip()},
seen AS (SELECT base.*, n.i AS round, n.i - 1 - CASE WHEN base.request_id % 7 = 3 THEN 1 ELSE 0 END AS answered,
         CASE WHEN f.ok1 THEN j1 ELSE '{DEFAULT_INTENT_JSON}' END AS first_j, res.j,
         ri.category, ri.intent_status = 'ok' AS usable, {_R1.replace("i.", "ri.")} AS r1, s.summary
       FROM base JOIN f ON f.request_id = base.request_id JOIN res ON res.request_id = base.request_id
       JOIN ri ON ri.intent_id = base.request_id LEFT JOIN summ s ON s.request_id = base.request_id
       CROSS JOIN (VALUES (1), (2), (3), (4)) AS n(i)),
due AS (
SELECT round, request_id, 1 AS step, {_lit(EXTRACT_HEAD)} || rtext AS text FROM seen WHERE answered < 1
UNION ALL
SELECT round, request_id, 2, {ra} || rtext || {rb} || {_json_by_key('first_j')} || {rc} || prof || {rd}
FROM seen WHERE answered = 1
UNION ALL
SELECT round, request_id, 3, {pa} || prof || {pb} || category || {pc} FROM seen WHERE answered = 2 AND usable AND r1
UNION ALL
SELECT round, request_id, 4, {oa} || prof_noamt || {ob} || {_json_by_key('j')} || {oc} || summary || {od} || rtext
FROM seen WHERE round = 4 AND usable AND answered >= CASE WHEN r1 THEN 3 ELSE 2 END AND summary IS NOT NULL)
SELECT CAST(round AS BIGINT) AS round, CAST(request_id AS BIGINT) AS request_id,
  CAST(step AS BIGINT) AS step, text FROM due"""
