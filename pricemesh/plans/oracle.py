"""The registered queries as SQL for an independent engine on the same tables.

Written against the rules, not against the Spark code: whole tables, plain SQL.
"""

from __future__ import annotations

from pricemesh import vocab
from pricemesh.sources import derived

AS_OF = "DATE '2026-09-28'"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _in(words) -> str:
    return "(" + ", ".join(_q(w) for w in words) + ")"


def _case(value: str, table: dict[str, str], default: str = "NULL") -> str:
    arms = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in table.items())
    return f"CASE {value} {arms} ELSE {default} END"


def _pick(values: list[str], index: str) -> str:
    return "([" + ", ".join(_q(v) for v in values) + f"])[(({index}) % {len(values)}) + 1]"


# --- offers ----------------------------------------------------------------------

OFFERS = """
base AS (
  SELECT l_partkey AS p, l_suppkey AS s, min(l_extendedprice) AS price, max(l_extendedprice) AS mrp,
         CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS review_count,
         min(abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) % 8) AS lead
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
l AS (
  SELECT p || '-' || s AS listing_id, p * 1000000 + s AS position, p AS product_id, p, s,
         lower(n_name) AS marketplace, s_name AS seller_name,
         p_name || ' ' || p_brand || ' size ' || p_size AS title, p_name, p_size, p_brand AS brand, p_type AS category,
         price, mrp, CAST(1 + ((s * 7 + p) % 9) * 0.5 AS DOUBLE) AS rating, review_count,
         CAST(CASE WHEN (p + 3 * s) % 13 = 0 THEN 99 ELSE lead END AS INTEGER) AS delivery_days,
         CASE WHEN (p + s) % 11 = 0 THEN 'out_of_stock' WHEN (p + s) % 7 = 0 THEN 'low_stock' ELSE 'in_stock' END AS availability,
         CASE WHEN mrp > 0 THEN round(greatest(0, (mrp - price) / mrp * 100), 1) ELSE 0 END AS discount_percentage
  FROM base JOIN part ON p = p_partkey JOIN supplier ON s = s_suppkey JOIN nation ON s_nationkey = n_nationkey)
"""

_LISTING_ORDER = {
    "price_asc": "price ASC", "price_desc": "price DESC",
    "delivery_fastest": "(availability = 'out_of_stock') ASC, delivery_days ASC, price ASC",
    "delivery_slowest": "delivery_days DESC", "rating_desc": "rating DESC, review_count DESC",
    "rating_asc": "rating ASC", "discount_desc": "discount_percentage DESC", "relevance": "relevance DESC, rating DESC",
}
_GROUP_ORDER = {
    "price_asc": "price_min ASC", "price_desc": "price_max DESC",
    "delivery_fastest": "coalesce(fastest_days, 99) ASC, price_min ASC", "delivery_slowest": "slowest_days DESC",
    "rating_desc": "rating_max DESC", "rating_asc": "rating_min ASC", "discount_desc": "discount_max DESC",
    "relevance": "rating_max DESC, listing_count DESC",
}


def _rollup(source: str, by: str, order: str) -> str:
    """CTEs ``ranked``, ``seen``, ``groups``."""
    known = "delivery_days < 90 AND (available OR NOT any_available)"
    return f"""
ranked AS (
  SELECT *, availability <> 'out_of_stock' AS available,
         bool_or(availability <> 'out_of_stock') OVER (PARTITION BY {by}) AS any_available,
         row_number() OVER (PARTITION BY {by} ORDER BY {order}, position) AS rk
  FROM {source}),
seen AS (
  SELECT {by}, string_agg(marketplace, ',' ORDER BY r) AS marketplaces, count(*) AS store_count
  FROM (SELECT {by}, marketplace, min(rk) AS r FROM ranked GROUP BY {by}, marketplace) GROUP BY {by}),
merged AS (
  SELECT {by},
         first(listing_id ORDER BY NOT available, price, rk) AS cheapest_listing,
         first(price ORDER BY NOT available, price, rk) AS cheapest_price,
         first(marketplace ORDER BY NOT available, price, rk) AS cheapest_store,
         first(listing_id ORDER BY delivery_days, price, rk) FILTER (WHERE {known}) AS fastest_listing,
         first(delivery_days ORDER BY delivery_days, price, rk) FILTER (WHERE {known}) AS fastest_days,
         first(marketplace ORDER BY delivery_days, price, rk) FILTER (WHERE {known}) AS fastest_store,
         min(price) AS price_min, max(price) AS price_max, min(rating) AS rating_min, max(rating) AS rating_max,
         max(discount_percentage) AS discount_max,
         coalesce(max(delivery_days) FILTER (WHERE {known}), 0) AS slowest_days,
         count(*) AS listing_count, min(position) AS group_position
  FROM ranked GROUP BY {by}),
groups AS (SELECT * FROM merged JOIN seen USING ({by}))
"""


_UNION = f"""WITH {OFFERS}, un AS (
  SELECT 'shelf-' || (p_partkey % 7) AS marketplace, CAST(p_partkey AS VARCHAR) AS listing_id, NULL AS seller_name,
         p_name || ' ' || p_brand || ' size ' || p_size AS title, p_retailprice AS price, CAST(1 + (p_partkey % 9) * 0.5 AS DOUBLE) AS rating, NULL AS currency FROM part
  UNION ALL SELECT 'market', listing_id, seller_name, title, price, rating, 'INR' FROM l)"""
_ROLLUP = """cheapest_listing, cheapest_price, cheapest_store, fastest_listing, fastest_days, fastest_store, price_min,
price_max, rating_min, rating_max, discount_max, slowest_days, store_count, listing_count, marketplaces"""


def _offers() -> dict[str, str]:
    out = {
        "offer_rollup": f"WITH {OFFERS}, {_rollup('l', 'product_id', 'price')} SELECT product_id, {_ROLLUP} FROM groups",
        "offers_filtered": f"""WITH {OFFERS},
kept AS (
  SELECT * FROM l WHERE price BETWEEN 2000 AND 60000 AND delivery_days <= 5 AND rating >= 2 AND availability <> 'out_of_stock'
  AND marketplace IN {_in(f'nation_{i}' for i in range(15))} AND lower(brand) IN {_in(f'brand#{i}' for i in range(1, 21))}),
{_rollup('kept', 'product_id', 'price')} SELECT product_id, {_ROLLUP} FROM groups""",
        "compare_chosen": f"""WITH {OFFERS}, chosen AS (SELECT *, seller_name AS request_id FROM l),
{_rollup('chosen', 'request_id', _LISTING_ORDER['delivery_fastest'])} SELECT request_id, {_ROLLUP} FROM groups""",
        "discounts": f"WITH {OFFERS} SELECT listing_id, discount_percentage FROM l",
        "delivery_info": f"""WITH {OFFERS}, d AS (SELECT *, {AS_OF} + delivery_days AS day FROM l)
SELECT listing_id, CAST(day AS VARCHAR) AS delivery_date,
       CASE WHEN availability = 'out_of_stock' THEN 'Currently unavailable' WHEN delivery_days <= 0 THEN 'Today'
            WHEN delivery_days = 1 THEN 'Tomorrow' WHEN delivery_days <= 3 THEN 'In ' || delivery_days || ' days'
            ELSE 'By ' || strftime(day, '%a, %d %b') END AS delivery_text FROM d""",
        "delivery_estimates": f"""WITH {OFFERS}, asked AS (
  SELECT CASE WHEN s % 7 = 0 THEN 'nowhere' ELSE marketplace END AS marketplace,
         CASE WHEN s % 2 = 0 THEN listing_id ELSE p || '-' || (s + 1) END AS listing_id FROM l)
SELECT a.marketplace, a.listing_id, coalesce(l.delivery_days, 5) AS delivery_days,
       coalesce(l.availability <> 'out_of_stock', false) AS available
FROM asked a LEFT JOIN l ON a.marketplace = l.marketplace AND a.listing_id = l.listing_id
WHERE a.marketplace IN (SELECT lower(n_name) FROM nation)""",
        "facets": f"""WITH {OFFERS} SELECT category, string_agg(DISTINCT marketplace, ',' ORDER BY marketplace) AS stores,
string_agg(DISTINCT brand, ',' ORDER BY brand) AS brands, count(DISTINCT marketplace) AS n_stores FROM l GROUP BY category""",
        "store_union": f"{_UNION} SELECT * FROM un",
        "point_lookup": f"""{_UNION}, asked AS (
  SELECT DISTINCT CASE WHEN l_orderkey % 9 < 8 THEN 'shelf-' || (l_orderkey % 9) ELSE 'market' END AS marketplace,
         CASE WHEN l_orderkey % 9 < 8 THEN CAST(l_partkey AS VARCHAR) ELSE l_partkey || '-' || l_suppkey END AS listing_id FROM lineitem)
SELECT marketplace, listing_id, title, price FROM asked LEFT JOIN un USING (marketplace, listing_id)""",
        "keyword_scan": f"""WITH {OFFERS} SELECT listing_id, title FROM l
WHERE contains(lower(title), 'ring') OR contains(lower(title), '7')""",
    }
    for sort in vocab.SORT_KEYS:
        out[f"offers_sorted_{sort}"] = f"""WITH {OFFERS}, r AS (SELECT *, 0.0 AS relevance FROM l)
SELECT product_id, listing_id, row_number() OVER (PARTITION BY product_id ORDER BY {_LISTING_ORDER[sort]}, position) AS rank FROM r"""
        out[f"group_sort_{sort}"] = f"""WITH {OFFERS}, {_rollup('l', 'product_id', 'price')}
SELECT product_id, row_number() OVER (ORDER BY {_GROUP_ORDER[sort]}, group_position) AS rank FROM groups"""
    return out


# --- text ---------------------------------------------------------------------------


def _normalize(x: str) -> str:
    """RE2 knows ASCII word ends only, so ends after a unit are spelt out."""
    t = f"(' ' || replace(replace(lower({x}), 'é', 'e'), '’', '''') || ' ')"
    for a, b in vocab.TITLE_ALIASES:
        t = f"replace({t}, {_q(a)}, {_q(b)})"
    end, start = r"([^\p{L}\p{M}\p{N}_]|$)", r"(^|[^\p{L}\p{M}\p{N}_])"
    space = r"[\s\x{00A0}\x{0085}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0b]"
    rules = [
        (rf"(\d){space}+(ml|g|l|ltrs|ltr|w|gb){end}", r"\1\2\3"),
        (rf"{start}ltrs?{end}", r"\1l\2"),
        (rf"{start}(\d\d)w(?:{space}*x{space}*\d\dl)?{end}", r"\1\2\3"),
        (rf"{start}(uk|size){space}+(\d\d?){end}", r"\1\3\4"),
        (r"[()\[\],/|]", " "),
        (rf"{space}+-{space}+", " "),
        (r"[^a-z0-9.'\-+ ]", " "),
        (r"\s+", " "),
    ]
    for pattern, to in rules:
        t = f"regexp_replace({t}, {_q(pattern)}, {_q(to)}, 'g')"
    return f"trim({t})"


def _tokens(normalized: str) -> str:
    women, men, unisex = (vocab.GENDER_WORDS[g] for g in ("women", "men", "unisex"))
    one = (
        f"CASE WHEN w IN {_in(women)} THEN 'women' WHEN w IN {_in(men)} THEN 'men' WHEN w IN {_in(unisex)} THEN 'unisex' "
        "WHEN length(w) > 3 AND right(w, 1) = 's' AND right(w, 2) <> 'ss' AND NOT regexp_matches(w, '[0-9]s$') "
        "THEN left(w, length(w) - 1) ELSE w END"
    )
    bare = f"list_transform(string_split({normalized}, ' '), lambda w: trim(w, '.''-'))"
    return (
        f"list_transform(list_filter({bare}, lambda w: w <> '' AND w NOT IN {_in(vocab.STOPWORDS)}), lambda w: {one})"
    )


def _first_option(text: str, options: list[str]) -> str:
    ordered = sorted(options, key=len, reverse=True)
    arms = " ".join(rf"WHEN regexp_matches({text}, {_q(chr(92) + 'b' + o + chr(92) + 'b')}) THEN {_q(o)}" for o in ordered)
    return f"CASE {arms} END"


def _none(x: str) -> str:
    return f"nullif({x}, '')"


SHELF = f"""
shelf AS (
  SELECT CAST(p_partkey AS VARCHAR) AS listing_id, p_partkey AS p, p_name || ' ' || p_brand || {_pick(derived.TITLE_ENDINGS, 'p_partkey')} AS title,
         CASE WHEN p_partkey % 11 = 0 THEN 'Levis' WHEN p_partkey % 11 = 1 THEN 'Generic' ELSE p_brand END AS brand,
         CASE WHEN p_partkey % 13 = 0 THEN 'Shoes' ELSE p_type END AS category, p_size
  FROM part)
"""


def _attributes(source: str, supplied: bool) -> str:
    """CTE ``attrs`` with one column per scored attribute, from ``source``(listing_id, title, brand, category, p, p_size)."""
    memory = r"\b(\d+(?:\.\d+)?)\s?(gb|tb)\b"
    ram = r"\b(\d{1,2})gb\s*ram\b|\bram\s*(\d{1,2})gb\b"
    quantity = r"\b(\d+(?:\.\d+)?)(ml|g|kg|l)\b"
    letter = r"\b(xs|s|m|l|xl|xxl|free)\b(?:[^a-z]|$)"
    colour = _first_option("text", vocab.COLOURS)
    fit = _first_option("text", vocab.FITS)
    gender = "CASE " + " ".join(
        rf"WHEN regexp_matches(text, {_q(chr(92) + 'b(' + '|'.join(ws) + ')' + chr(92) + 'b')}) THEN {_q(g)}"
        for g, ws in vocab.GENDER_WORDS.items()
    ) + " END"
    number = "TRY_CAST(regexp_extract(m, '[0-9.]+') AS DOUBLE)"
    fold_brand = _case("b", vocab.BRAND_ALIASES, "b")
    own = {}
    if supplied:
        five = lambda at0, at1, other: f"CASE p % 5 WHEN 0 THEN {at0} WHEN 1 THEN {at1} ELSE {other} END"
        own = {
            "colour": five("'clear'", "colour", "colour"),
            "quantity": five("p_size || ' ml'", "quantity", "quantity"),
            "shade": five("'mr1'", "NULL", "NULL"),
            "size": five("size", "CAST(p_size AS VARCHAR)", "size"),
            "storage": five("storage", "'64 gb'", "storage"),
            "fit": five("fit", "'oversized'", "fit"),
            "model": five("NULL", "'galaxy s25'", "NULL"),
        }
    keys = ", ".join(f"{own.get(k, k if k not in ('model', 'shade', 'capacity', 'variant') else 'CAST(NULL AS VARCHAR)')} AS {k}" for k in vocab.ATTRIBUTE_WEIGHTS)
    return f"""
texts AS (SELECT *, {_normalize("title || ' '")} AS text, trim(lower(brand)) AS b, trim(lower(category)) AS cat FROM {source}),
plain AS (SELECT *, regexp_replace(text, '\\b[2345]g\\b', ' ', 'g') AS pl FROM texts),
mem AS (SELECT *, {_none(f"regexp_extract(pl, {_q(ram)}, 1) || regexp_extract(pl, {_q(ram)}, 2)")} || ' gb' AS ram FROM plain),
sized AS (
  SELECT *, list_sort([{{'v': {number} * CASE WHEN right(m, 2) = 'tb' THEN 1024 ELSE 1 END,
                        'n': regexp_extract(m, '[0-9.]+') || ' ' || right(m, 2)}} FOR m IN regexp_extract_all(pl, {_q(memory)})]) AS sizes FROM mem),
inferred AS (
  SELECT *, {_case(colour, vocab.COLOUR_ALIASES, colour)} AS colour, {_first_option("text", vocab.MATERIALS)} AS material,
         {_case(fit, vocab.FIT_ALIASES, fit)} AS fit, {gender} AS gender,
         list_filter(sizes, lambda z: ram IS NULL OR z.n <> ram)[-1].n AS storage,
         CASE WHEN regexp_matches(pl, {_q(quantity)}) THEN regexp_extract(pl, {_q(quantity)}, 1) || ' ' || regexp_extract(pl, {_q(quantity)}, 2) END AS quantity,
         {_none("regexp_extract(pl, '" + chr(92) + "b([0-9]+)w" + chr(92) + "b', 1)")} || 'W' AS wattage,
         coalesce({_none("regexp_extract(pl, '" + chr(92) + "b(?:uk|size)" + chr(92) + "s*([0-9][0-9]?)" + chr(92) + "b', 1)")},
                  CASE WHEN regexp_extract(replace(pl, ' size', ''), {_q(letter)}, 1) NOT IN ('', 's', 'm', 'l')
                       THEN regexp_extract(replace(pl, ' size', ''), {_q(letter)}, 1) END) AS size
  FROM sized),
attrs AS (
  SELECT * EXCLUDE (brand, category, colour, material, fit, gender, storage, quantity, wattage, size, ram), {keys} FROM (
    SELECT * EXCLUDE (brand, category), CASE WHEN {fold_brand} NOT IN {_in(vocab.GENERIC_BRANDS)} THEN {fold_brand} END AS brand,
           {_case("cat", vocab.CATEGORY_ALIASES, "cat")} AS category FROM inferred))
"""


_ATTRS_TEXT = "concat_ws(' ', title, brand, category, colour, size, model, quantity, shade, wattage, capacity, variant)"


_CLEAN = r"""trim(regexp_replace(regexp_replace(regexp_replace(title, '\s*\([^)]*\)\s*', ' ', 'g'), '(?i)\s*,\s*[^,]*\d+\s*(w|g|ml|l|ltrs)?\s*$', ''), '\s+', ' ', 'g'), ' -,')"""


def _presentation() -> str:
    """Values, letter by letter for the capitals; a letter after no letter, digit or _ starts a word."""
    word = lambda i: f"regexp_matches(v[{i}:{i}], '[A-Za-z0-9_]')"
    capitals = f"array_to_string([CASE WHEN {word('i')} AND NOT (i > 1 AND {word('i-1')}) THEN upper(v[i:i]) ELSE v[i:i] END FOR i IN range(1, length(v) + 1)], '')"
    shown = ", ".join(k if k in vocab.ATTRIBUTE_WEIGHTS else "NULL" for k in vocab.SUBTITLE_ATTRIBUTES)
    return f"""WITH {OFFERS}, {_rollup('l', 'product_id', 'price')}, {SHELF}, {_attributes('shelf', True)},
vals AS (SELECT listing_id, list_filter([{shown}], lambda x: x IS NOT NULL AND x <> '') AS vs FROM attrs),
one AS (SELECT listing_id, v, min(i) AS i FROM (SELECT listing_id, unnest(vs) AS v, unnest(range(len(vs))) AS i FROM vals) GROUP BY 1, 2),
four AS (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY i) AS nth FROM one),
sub AS (SELECT listing_id, string_agg(CASE WHEN regexp_matches(v, '[0-9]') THEN v ELSE {capitals} END, ' · ' ORDER BY i) AS subtitle FROM four WHERE nth <= 4 GROUP BY 1),
told AS (SELECT *, listing_count * 317 AS n FROM groups)
SELECT a.listing_id, coalesce(subtitle, '') AS subtitle,
       CASE WHEN n >= 100000 THEN format('{{:.1f}}L', n / 100000) WHEN n >= 10000 THEN format('{{:.0f}}k', n / 1000)
            WHEN n >= 1000 THEN format('{{:.1f}}k', n / 1000) ELSE CAST(n AS VARCHAR) END AS reviews_shown,
       CASE WHEN price_max > price_min THEN price_max - price_min END AS saving, {_CLEAN} AS clean_title
FROM attrs a JOIN told ON product_id = a.p LEFT JOIN sub ON sub.listing_id = a.listing_id"""


def _text() -> dict[str, str]:
    idf = "round((1 + ln(n / df)) * 1000000) / 1000000"
    title_tokens = _tokens(_normalize("title"))
    return {
        "presentation": _presentation(),
        "title_tokens": f"""WITH {SHELF}, {_attributes('shelf', True)}
SELECT listing_id, {_normalize('title')} AS normalized_title, array_to_string({title_tokens}, ' ') AS tokens,
       array_to_string({_tokens(_normalize(_ATTRS_TEXT))}, ' ') AS search_text FROM attrs""",
        "attributes_inferred": f"WITH {SHELF}, {_attributes('shelf', True)} SELECT listing_id, {', '.join(vocab.ATTRIBUTE_WEIGHTS)} FROM attrs",
        "document_tokens": f"""WITH t AS (SELECT doc_id, {_tokens(_normalize('text'))} AS t FROM documents)
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM t""",
        "corpus_idf": f"""WITH t AS (SELECT {_tokens(_normalize('text'))} AS t FROM documents),
c AS (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(t)) AS token FROM t) GROUP BY token)
SELECT token, df, {idf} AS idf FROM c, (SELECT CAST(count(*) AS DOUBLE) AS n FROM documents)""",
        "hash_embedding": f"""WITH t AS (SELECT CAST(p_partkey AS VARCHAR) AS listing_id, {_tokens(_normalize("p_name || ' ' || p_brand || ' size ' || p_size"))} AS t FROM part),
w AS (SELECT listing_id, unnest(t) AS tok FROM t),
f AS (SELECT listing_id, 'w:' || tok AS f, 2 AS w FROM w UNION ALL
      SELECT listing_id, 'g:' || substring('#' || tok || '#', i, 3), 1 FROM (SELECT listing_id, tok, unnest(range(1, length(tok) + 1)) AS i FROM w)),
b AS (SELECT listing_id, CAST('0x' || substring(md5(f), 1, 8) AS BIGINT) % 512 AS bucket, CAST(sum(w) AS BIGINT) AS w FROM f GROUP BY 1, 2),
n AS (SELECT listing_id, sqrt(CAST(sum(w * w) AS DOUBLE)) AS norm FROM b GROUP BY 1)
SELECT listing_id, bucket, round(w / norm, 6) AS weight FROM b JOIN n USING (listing_id)""",
        "dense_cosine": """SELECT a.vec_id, round(least(1.0, greatest(0.0, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 6) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
        "hash_similarity": """WITH h AS (SELECT p_partkey AS position, md5(p_name) AS m FROM part),
v AS (SELECT position, CAST('0x' || substring(m, 1, 8) AS BIGINT) AS hi, CAST('0x' || substring(m, 9, 8) AS BIGINT) AS lo FROM h)
SELECT a.position, round(1 - (bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo))) / 64.0, 4) AS similarity
FROM v a JOIN v b ON b.position = a.position + 1""",
    }



# --- scored matching -------------------------------------------------------------------


def _pairs(sent: str = "") -> str:
    """``sent``: rows from position 1,000,000,000 on that are scored but count in no statistics."""
    kept = "WHERE pos < 1000000000" if sent else ""
    title = "p_name || ' ' || p_brand || ' size ' || p_size"
    text = _normalize("title || ' ' || descr")
    colour = _first_option("text", vocab.COLOURS)
    product = "concat_ws(' ', title, lower(brand), lower(category), colour, size)"
    return f"""
cat AS (SELECT p_partkey AS pos, {title} AS title, p_type || ' ' || p_name AS descr, p_brand AS brand, p_type AS category,
               CAST(p_size AS VARCHAR) AS size, substring(md5(p_name), 1, 16) AS h FROM part {sent}),
col AS (SELECT *, {_case(colour, vocab.COLOUR_ALIASES, colour)} AS colour FROM (SELECT *, {text} AS text FROM cat)),
tok AS (SELECT *, {_tokens(_normalize(product))} AS toks, list_sort(list_distinct({_tokens(_normalize('title'))})) AS names FROM col),
prof AS (SELECT toks, names, lower(brand) AS brand, lower(category) AS category, colour, size, h, min(pos) AS pid, count(*) AS copies
         FROM tok GROUP BY ALL),
member AS (SELECT t.*, p.pid FROM tok t JOIN prof p ON t.toks = p.toks AND t.names = p.names AND lower(t.brand) = p.brand
           AND lower(t.category) = p.category AND t.colour IS NOT DISTINCT FROM p.colour AND t.size = p.size AND t.h = p.h),
idf AS (SELECT w, CAST(round((1 + ln(n / count(*))) * 1000000) AS BIGINT) AS micros
        FROM (SELECT unnest(names) AS w FROM tok {kept}), (SELECT CAST(count(*) AS DOUBLE) AS n FROM tok {kept}) GROUP BY w, n),
pw AS (SELECT pid, p.w, coalesce(micros, CASE WHEN regexp_matches(p.w, '[0-9]') THEN 3000000 ELSE 2000000 END) AS micros
       FROM (SELECT pid, unnest(list_distinct(toks)) AS w FROM prof) p LEFT JOIN idf USING (w)),
tot AS (SELECT pid, sum(micros) AS total FROM pw GROUP BY pid),
pt AS (SELECT pid, unnest(toks) AS t FROM prof),
pf AS (SELECT pid, 'w:' || t AS f, 2 AS x FROM pt UNION ALL
       SELECT pid, 'g:' || substring('#' || t || '#', i, 3), 1 FROM (SELECT pid, t, unnest(range(1, length(t) + 1)) AS i FROM pt)),
pb AS (SELECT pid, CAST('0x' || substring(md5(f), 1, 8) AS BIGINT) % 512 AS bkt, sum(x) AS x FROM pf GROUP BY 1, 2),
nrm AS (SELECT pid, sqrt(CAST(sum(x * x) AS DOUBLE)) AS n FROM pb GROUP BY pid)"""


# The combined score is rounded on its shortest decimal form: many sums of scores
# lie next to a tie, where rounding through a multiplication goes the wrong way.
_SCORED = r"""
shared AS (SELECT a, b, sum(x.micros) AS shared FROM asked JOIN pw x ON x.pid = a JOIN pw y ON y.pid = b AND y.w = x.w GROUP BY 1, 2),
dots AS (SELECT a, b, sum(x.x * y.x) AS dot FROM asked JOIN pb x ON x.pid = a JOIN pb y ON y.pid = b AND y.bkt = x.bkt GROUP BY 1, 2),
sc AS (
  SELECT k.a, k.b, pa.copies AS ca, pb2.copies AS cb, pa.brand AS ba, pb2.brand AS bb, pa.category AS ga, pb2.category AS gb,
         pa.colour AS la, pb2.colour AS lb, pa.size AS sa, pb2.size AS sb,
         round(0.5 * (2.0 * coalesce(shared, 0) / (ta.total + tb.total)) + 0.5 * least(1.0, coalesce(dot, 0) / (na.n * nb.n)), 4) AS text_score,
         round(1 - (bit_count(xor(CAST('0x' || pa.h[1:8] AS BIGINT), CAST('0x' || pb2.h[1:8] AS BIGINT)))
                  + bit_count(xor(CAST('0x' || pa.h[9:16] AS BIGINT), CAST('0x' || pb2.h[9:16] AS BIGINT)))) / 64.0, 4) AS image_score
  FROM asked k JOIN prof pa ON pa.pid = k.a JOIN prof pb2 ON pb2.pid = k.b
  LEFT JOIN shared USING (a, b) LEFT JOIN dots USING (a, b)
  JOIN tot ta ON ta.pid = k.a JOIN tot tb ON tb.pid = k.b JOIN nrm na ON na.pid = k.a JOIN nrm nb ON nb.pid = k.b),
att0 AS (
  SELECT *, round((CASE WHEN ba = bb THEN 3.0 ELSE 0 END + CASE WHEN ga = gb THEN 2.0 ELSE 0 END + CASE WHEN la = lb THEN 2.0 ELSE 0 END
                   + CASE WHEN sa = sb THEN 2.0 ELSE 0 END)
                  / (7.0 + CASE WHEN la IS NOT NULL AND lb IS NOT NULL THEN 2.0 ELSE 0 END), 4) AS attribute_score,
         ba <> bb OR ga <> gb AS other, sa <> sb OR coalesce(la <> lb, false) AS variant FROM sc),
rw AS (SELECT *, CAST(round(CAST(CAST(least(1.0, CAST(text_score AS DOUBLE) * CAST(0.4 AS DOUBLE) + CAST(attribute_score AS DOUBLE) * CAST(0.25 AS DOUBLE)
       + CAST(image_score AS DOUBLE) * CAST(0.35 AS DOUBLE)) AS VARCHAR) AS DECIMAL(30, 18)), 4) AS DOUBLE) AS raw FROM att0),
scored AS (
  SELECT *, CASE WHEN other THEN 'DIFFERENT' WHEN raw >= 0.9 AND NOT variant THEN 'EXACT_MATCH' WHEN raw >= 0.7 THEN 'SIMILAR' ELSE 'DIFFERENT' END AS match_type,
         round(CASE WHEN other THEN least(raw, 0.69) WHEN raw >= 0.7 AND variant THEN least(raw, 0.89) ELSE raw END, 4) AS combined_score,
         CASE WHEN a = b THEN ca * (ca - 1) // 2 ELSE ca * cb END AS n_pairs,
         concat_ws(';', CASE WHEN ba = bb THEN 'Same brand:ok' ELSE 'Brand differs (' || ba || ' vs ' || bb || '):warn' END,
           CASE WHEN ga = gb THEN 'Same product category:ok' ELSE 'Product category differs (' || ga || ' vs ' || gb || '):warn' END,
           CASE WHEN la = lb THEN 'Same colour:ok' WHEN la <> lb THEN 'Colour differs (' || la || ' vs ' || lb || '):warn' END,
           CASE WHEN sa = sb THEN 'Same size:ok' ELSE 'Size differs (' || sa || ' vs ' || sb || '):warn' END,
           CASE WHEN image_score >= 0.9 THEN 'Similar product imagery:ok' WHEN image_score >= 0.75 THEN 'Partially similar imagery:warn' ELSE 'Imagery differs:warn' END,
           CASE WHEN text_score >= 0.7 THEN 'Similar product title:ok' WHEN text_score >= 0.45 THEN 'Partially similar title:warn' ELSE 'Titles differ:warn' END) AS reasons
  FROM rw),
kept AS (SELECT * FROM scored WHERE match_type <> 'DIFFERENT')"""

# Pairs of another brand or category always end as different.
_ALL_PAIRS = """
asked AS (SELECT x.pid AS a, y.pid AS b FROM prof x JOIN prof y ON x.brand = y.brand AND x.category = y.category
          AND (x.pid < y.pid OR (x.pid = y.pid AND x.copies > 1)))"""

_CLASSES = """
edge AS (SELECT a, b FROM kept WHERE match_type = 'EXACT_MATCH' UNION SELECT b, a FROM kept WHERE match_type = 'EXACT_MATCH'),
reach AS (SELECT pid AS x, pid AS y FROM prof UNION SELECT r.x, e.b FROM reach r JOIN edge e ON e.a = r.y),
class AS (SELECT x AS pid, min(y) AS cid FROM reach GROUP BY x),
memc AS (SELECT m.*, cid FROM member m JOIN class USING (pid))"""


def _matching() -> dict[str, str]:
    pairs = f"WITH RECURSIVE {_pairs()}, {_ALL_PAIRS}, {_SCORED}"
    columns = "text_score, attribute_score, image_score, combined_score, match_type"
    sent = """UNION ALL SELECT 1000000000 + p_partkey, p_name || ' spare x' || p_partkey || ' size ' || p_size, p_type || ' ' || p_name, p_brand, p_type,
               CAST(p_size AS VARCHAR), substring(md5(p_name), 1, 16) FROM part WHERE p_partkey % 3 = 0"""
    central = """
incl AS (SELECT a AS pid, combined_score * (cb - CASE WHEN a = b THEN 1 ELSE 0 END) AS pts, a, b FROM kept
         UNION ALL SELECT b, combined_score * ca, a, b FROM kept WHERE a <> b),
cen AS (SELECT i.pid, sum(CAST(pts AS DECIMAL(18, 4))) AS c FROM incl i JOIN class x ON x.pid = i.a JOIN class y ON y.pid = i.b WHERE x.cid = y.cid GROUP BY 1)"""
    votes = """
kv AS (SELECT cid, pos, unnest(['brand', 'category', 'colour', 'size']) AS k, unnest([lower(brand), lower(category), colour, size]) AS v FROM memc),
vt AS (SELECT cid, k, v, count(*) AS n, min(pos) AS f FROM kv WHERE v IS NOT NULL GROUP BY 1, 2, 3),
bst AS (SELECT cid, k, first(v ORDER BY n DESC, f) AS v FROM vt GROUP BY 1, 2),
att AS (SELECT cid, string_agg(k || '=' || v, ';' ORDER BY k) AS attributes, max(v) FILTER (WHERE k = 'brand') AS brand,
               max(v) FILTER (WHERE k = 'category') AS category FROM bst GROUP BY 1)"""
    return {
        "pair_scores": f"{pairs} SELECT a AS profile_a, b AS profile_b, n_pairs, {columns} FROM kept",
        "pair_reasons": f"{pairs} SELECT a AS profile_a, b AS profile_b, reasons FROM kept",
        "requested_pairs": f"""WITH {_pairs()}, asked AS (SELECT x.pid AS a, y.pid AS b FROM prof x JOIN prof y ON y.pid = x.pid + 1), {_SCORED}
SELECT a AS profile_a, b AS profile_b, {columns} FROM scored""",
        "title_contains": """WITH needles AS (
  SELECT DISTINCT trim(lower(unnest([substr(p_name, 2, 1), substr(p_name, 3, 2), substr(p_name, 2, 4), p_brand, 'size ' || p_size, 'zq' || p_size]))) AS needle FROM part),
titles AS (SELECT p_partkey AS pos, lower(p_name || ' ' || p_brand || ' size ' || p_size) AS title FROM part)
SELECT needle, count(*) AS titles, min(pos) AS first_position, CAST(sum(pos) AS BIGINT) AS positions
FROM needles JOIN titles ON needle <> '' AND contains(title, needle) GROUP BY needle""",
        "match_requests": f"""WITH {_pairs(sent)},
req AS (SELECT p_partkey AS x, CASE WHEN p_partkey % 3 = 0 THEN 1000000000 + p_partkey ELSE p_partkey + 1 END AS y FROM part),
ask AS (SELECT x, y, ma.pid AS a, mb.pid AS b FROM req LEFT JOIN member ma ON ma.pos = x LEFT JOIN member mb ON mb.pos = y),
asked AS (SELECT DISTINCT a, b FROM ask WHERE a IS NOT NULL AND b IS NOT NULL), {_SCORED}
SELECT CAST(x AS VARCHAR) AS request_id, CAST(x AS VARCHAR) AS listing_a, CASE WHEN x % 3 = 0 THEN 'adhoc-b' ELSE CAST(y AS VARCHAR) END AS listing_b,
       CASE WHEN match_type IS NULL THEN 'missing' ELSE 'scored' END AS outcome, {columns}, reasons FROM ask LEFT JOIN scored USING (a, b)""",
        "product_components": f"{pairs}, {_CLASSES} SELECT CAST(pos AS VARCHAR) AS listing_id, cid AS product_id FROM memc",
        "canonical_products": f"""{pairs}, {_CLASSES}, {central}, {votes},
shown AS (
  SELECT cid, first(title ORDER BY coalesce(c, 0) DESC, pos) AS title, first(descr ORDER BY length(descr) DESC, pos) AS description,
         first('/img/' || pos ORDER BY pos * 7 % 1000 DESC, pos) AS canonical_image, count(*) AS listing_count
  FROM memc LEFT JOIN cen USING (pid) GROUP BY cid)
SELECT cid AS product_id, {_CLEAN} AS canonical_title, brand, category, description, canonical_image, attributes, listing_count
FROM shown JOIN att USING (cid)""",
        "explanations": f"""{pairs}, {_CLASSES},
inside AS (SELECT k.*, x.cid FROM kept k JOIN class x ON x.pid = k.a JOIN class y ON y.pid = k.b WHERE x.cid = y.cid AND match_type = 'EXACT_MATCH'),
agg AS (
  SELECT cid, CAST(sum(n_pairs) AS BIGINT) AS pair_count, CAST(round(sum(combined_score * n_pairs) / sum(n_pairs) * 100) AS BIGINT) AS confidence,
         round(sum(text_score * n_pairs) / sum(n_pairs), 3) AS text, round(sum(attribute_score * n_pairs) / sum(n_pairs), 3) AS attribute,
         round(sum(image_score * n_pairs) / sum(n_pairs), 3) AS image FROM inside GROUP BY cid),
said AS (SELECT cid, a, b, n_pairs, unnest(string_split(reasons, ';')) AS r, unnest(range(len(string_split(reasons, ';')))) AS k FROM inside),
cnt AS (SELECT cid, r, sum(n_pairs) AS n, min(ROW(a, b, k)) AS f FROM said GROUP BY 1, 2),
good AS (SELECT cid, r, n, f FROM cnt JOIN agg USING (cid)
         WHERE CASE WHEN r LIKE '%:ok' THEN n * 2 >= pair_count ELSE n * 3 >= greatest(3, pair_count) END)
SELECT cid AS product_id, pair_count, confidence, text, attribute, image, string_agg(r, ';' ORDER BY r NOT LIKE '%:ok', n DESC, f) AS reasons
FROM agg JOIN good USING (cid) GROUP BY ALL""",
        "similar_products": f"""{pairs}, {_CLASSES},
way AS (SELECT x.cid AS f, y.cid AS t, k.* FROM kept k JOIN class x ON x.pid = k.a JOIN class y ON y.pid = k.b WHERE x.cid <> y.cid AND match_type = 'SIMILAR'
        UNION ALL SELECT y.cid, x.cid, k.* FROM kept k JOIN class x ON x.pid = k.a JOIN class y ON y.pid = k.b WHERE x.cid <> y.cid AND match_type = 'SIMILAR'),
bst AS (SELECT f, t, first(combined_score ORDER BY combined_score DESC, a, b) AS s, first(reasons ORDER BY combined_score DESC, a, b) AS reasons FROM way GROUP BY 1, 2)
SELECT f AS product_id, t AS other_product, CAST(round(s * 100) AS BIGINT) AS similarity, reasons,
       array_to_string([regexp_replace(r, ':warn$', '') FOR r IN string_split(reasons, ';') IF r LIKE '%:warn'][1:3], ';') AS telling FROM bst""",
        "batch_summary": f"""{pairs}, {_CLASSES}, g AS (SELECT cid, count(*) AS n FROM memc GROUP BY 1)
SELECT 'marketplaces' AS measure, count(DISTINCT pos % 7) AS value FROM tok UNION ALL SELECT 'listings', count(*) FROM tok
UNION ALL SELECT 'products', count(*) FROM g UNION ALL SELECT 'multi_listing_groups', count(*) FROM g WHERE n > 1
UNION ALL SELECT 'matches', CAST(coalesce(sum(n_pairs), 0) AS BIGINT) FROM kept""",
    }


def _details() -> dict[str, str]:
    """Listing by listing: products over exact pairs, similar pairs of listings of two products."""
    hashed = _pairs().replace("substring(md5(p_name), 1, 16) AS h", "CASE WHEN p_size % 2 = 1 THEN substring(md5(p_name), 1, 16) ELSE '' END AS h")
    scored = (
        _SCORED.replace("CAST('0x'", "TRY_CAST('0x'").replace("round(1 - (bit_count", "coalesce(round(1 - (bit_count")
        .replace(") / 64.0, 4) AS image_score", ") / 64.0, 4), 0.5) AS image_score")
    )
    rows = f"""WITH RECURSIVE {hashed}, {_ALL_PAIRS}, {scored}, {_CLASSES},
li AS (
  SELECT m.pos, m.pid, CASE WHEN copies = 1 OR m.pid IN (SELECT a FROM edge) THEN cid ELSE m.pos END AS product_id, 'store-' || (m.pos % 7) AS marketplace,
         p_retailprice AS price, m.pos % 8 AS delivery_days, '/img/' || (m.pos % 3) AS image_url
  FROM memc m JOIN prof USING (pid) JOIN part ON p_partkey = m.pos),
pr AS (SELECT product_id, count(*) AS listing_count, count(DISTINCT marketplace) AS store_count, CAST(first(pos ORDER BY price, pos) AS VARCHAR) AS cheapest_listing,
              CAST(first(pos ORDER BY delivery_days, price, pos) AS VARCHAR) AS fastest_listing FROM li GROUP BY 1),
two AS (SELECT x.product_id, y.product_id AS other_product, x.pos < y.pos AS once, k.* FROM li x JOIN li y ON x.pos <> y.pos JOIN kept k ON k.a = least(x.pid, y.pid) AND k.b = greatest(x.pid, y.pid)),
sm AS (SELECT product_id, other_product, first(combined_score ORDER BY combined_score DESC, a, b) AS s, first(reasons ORDER BY combined_score DESC, a, b) AS reasons
       FROM two WHERE match_type = 'SIMILAR' AND product_id <> other_product GROUP BY 1, 2)"""
    return {
        "product_images": f"""{rows}, im AS (SELECT product_id, image_url, min(ROW(price, pos)) AS f FROM li GROUP BY 1, 2)
SELECT product_id, image_url, row_number() OVER (PARTITION BY product_id ORDER BY f) AS image_rank FROM im""",
        "product_similar": f"""{rows} SELECT sm.product_id, other_product, row_number() OVER (PARTITION BY sm.product_id ORDER BY s DESC, other_product) AS place,
CAST(round(s * 100) AS BIGINT) AS similarity, listing_count, reasons FROM sm JOIN pr ON pr.product_id = other_product""",
        "product_detail": f"""{rows},
ex AS (SELECT * FROM two WHERE once AND match_type = 'EXACT_MATCH' AND product_id = other_product),
ag AS (SELECT product_id, count(*) AS pair_count, CAST(round(sum(combined_score) / count(*) * 100) AS BIGINT) AS confidence FROM ex GROUP BY 1),
sd AS (SELECT product_id, a, b, unnest(string_split(reasons, ';')) AS r, unnest(range(len(string_split(reasons, ';')))) AS k FROM ex),
ct AS (SELECT product_id, r, count(*) AS n, min(ROW(a, b, k)) AS f FROM sd GROUP BY 1, 2),
wh AS (SELECT product_id, string_agg(r, ';' ORDER BY r NOT LIKE '%:ok', n DESC, f) AS reasons FROM ct JOIN ag USING (product_id)
       WHERE CASE WHEN r LIKE '%:ok' THEN n * 2 >= pair_count ELSE n * 3 >= greatest(3, pair_count) END GROUP BY 1),
ns AS (SELECT sm.product_id, count(*) AS n_similar, sum(o.listing_count) AS more FROM sm JOIN pr o ON o.product_id = other_product GROUP BY 1)
SELECT product_id, cheapest_listing, fastest_listing, listing_count, store_count, coalesce(n_similar, 0) AS n_similar,
       CAST(listing_count + coalesce(more, 0) AS BIGINT) AS all_listings, confidence, pair_count, reasons
FROM pr LEFT JOIN ns USING (product_id) LEFT JOIN ag USING (product_id) LEFT JOIN wh USING (product_id)""",
    }


# --- search --------------------------------------------------------------------------------


def _coverage(queries: str, texts: str) -> str:
    """CTE ``hits``(query_id, text, coverage) from ``queries``(query_id, query) and ``texts``(text, copies)."""
    synonyms = ", ".join(f"({_q(k)}, {_q(w)})" for k, ws in vocab.SEARCH_SYNONYMS.items() for w in ws)
    return f"""
syn(q, w) AS (VALUES {synonyms}),
qt AS (SELECT query_id, q, count(*) AS times FROM (SELECT query_id, unnest({_tokens(_normalize('query'))}) AS q FROM {queries}) GROUP BY 1, 2),
words AS (SELECT DISTINCT text, unnest(string_split(text, ' ')) AS w FROM {texts} WHERE text <> ''),
sidf AS (SELECT w, CAST(round((1 + ln(n / sum(copies))) * 1000000) AS BIGINT) AS micros
         FROM words JOIN {texts} USING (text), (SELECT CAST(sum(copies) AS DOUBLE) AS n FROM {texts}) GROUP BY w, n),
qw AS (SELECT query_id, q, times, coalesce(micros, 2500000) AS micros FROM qt LEFT JOIN sidf ON w = q),
vocab AS (SELECT DISTINCT w FROM words),
near AS (
  SELECT q, w, CASE WHEN w = q THEN 10 WHEN length(q) >= 4 AND starts_with(w, q) THEN 6 ELSE 0 END AS tenths, 1 AS holds
  FROM (SELECT DISTINCT q FROM qt) JOIN vocab ON contains(w, q)
  UNION ALL SELECT q, w, 7, 0 FROM syn),
credit AS (SELECT text, q, max(tenths) AS tenths, max(holds) AS holds FROM near JOIN words USING (w) GROUP BY 1, 2),
allq AS (SELECT query_id, sum(times * micros) AS total FROM qw GROUP BY 1),
hits AS (SELECT query_id, text, CAST(sum(tenths * times * micros) AS DOUBLE) / (10 * any_value(total)) AS coverage
         FROM qw JOIN credit USING (q) JOIN allq USING (query_id) GROUP BY 1, 2
         HAVING max(holds) = 1 AND CAST(sum(tenths * times * micros) AS DOUBLE) / (10 * any_value(total)) >= 0.55)"""


def _search_pages() -> str:
    sorts = "[" + ", ".join(_q(s) for s in vocab.SORT_KEYS) + "]"
    listing = """CASE sort WHEN 'price_asc' THEN price WHEN 'price_desc' THEN -price WHEN 'delivery_fastest' THEN CAST(availability = 'out_of_stock' AS INT)
WHEN 'delivery_slowest' THEN -delivery_days WHEN 'rating_desc' THEN -rating WHEN 'rating_asc' THEN rating WHEN 'discount_desc' THEN -discount_percentage ELSE -relevance END,
CASE sort WHEN 'delivery_fastest' THEN delivery_days WHEN 'rating_desc' THEN -review_count WHEN 'relevance' THEN -rating ELSE 0 END,
CASE sort WHEN 'delivery_fastest' THEN price ELSE 0 END"""
    group = """CASE sort WHEN 'price_asc' THEN price_min WHEN 'price_desc' THEN -price_max WHEN 'delivery_fastest' THEN coalesce(fastest_days, 99)
WHEN 'delivery_slowest' THEN -slowest_days WHEN 'rating_desc' THEN -rating_max WHEN 'rating_asc' THEN rating_min WHEN 'discount_desc' THEN -discount_max ELSE -relevance END,
CASE sort WHEN 'delivery_fastest' THEN price_min WHEN 'relevance' THEN -listing_count ELSE 0 END"""
    return f"""WITH RECURSIVE {_pairs()}, {_ALL_PAIRS}, {_SCORED}, {_CLASSES},
lt AS (
  SELECT pos AS position, CAST(pos AS VARCHAR) AS listing_id, cid AS product_id, pid, 'store-' || (pos % 7) AS marketplace, p_retailprice AS price,
         round(greatest(0, (p_retailprice + 10 - p_retailprice) / (p_retailprice + 10) * 100), 1) AS discount_percentage, 1 + (pos % 9) * 0.5 AS rating,
         pos * 7 % 1000 AS review_count, pos % 8 AS delivery_days, 'in_stock' AS availability, array_to_string(toks, ' ') AS text
  FROM memc JOIN part ON p_partkey = pos),
texts AS (SELECT text, count(*) AS copies FROM lt GROUP BY text),
qs AS (SELECT query, query AS query_id, z, {sorts}[z % {len(vocab.SORT_KEYS)} + 1] AS sort FROM (SELECT p_name || ' ' || p_type AS query, max(p_size) AS z FROM part GROUP BY 1)),
{_coverage('qs', 'texts')},
found AS (SELECT h.query_id, sort, z, lt.*, round(coverage + 0.05 * least(1.0, review_count / 10000), 4) AS relevance
          FROM hits h JOIN lt USING (text) JOIN qs ON qs.query_id = h.query_id),
pass AS (SELECT *, query_id || chr(1) || product_id AS g FROM found WHERE (z % 3 <> 0 OR delivery_days <= 5) AND (z % 2 <> 0 OR rating >= 1.5)),
best AS (SELECT query_id, product_id, any_value(sort) AS sort, round(max(relevance), 3) AS relevance FROM found GROUP BY 1, 2),
two AS (
  SELECT f.query_id, f.product_id, k.* FROM found f JOIN found o ON o.query_id = f.query_id AND o.product_id = f.product_id AND o.position > f.position
  JOIN kept k ON k.a = least(f.pid, o.pid) AND k.b = greatest(f.pid, o.pid) WHERE match_type = 'EXACT_MATCH'),
agg AS (
  SELECT query_id, product_id, count(*) AS pair_count, CAST(round(sum(combined_score) / count(*) * 100) AS BIGINT) AS confidence,
         round(sum(text_score) / count(*), 3) AS text, round(sum(attribute_score) / count(*), 3) AS attribute, round(sum(image_score) / count(*), 3) AS image
  FROM two GROUP BY 1, 2),
sd AS (SELECT query_id, product_id, a, b, unnest(string_split(reasons, ';')) AS r, unnest(range(len(string_split(reasons, ';')))) AS k FROM two),
ct AS (SELECT query_id, product_id, r, count(*) AS n, min(ROW(a, b, k)) AS f FROM sd GROUP BY 1, 2, 3),
wh AS (SELECT query_id, product_id, string_agg(r, ';' ORDER BY r NOT LIKE '%:ok', n DESC, f) AS reasons FROM ct JOIN agg USING (query_id, product_id)
       WHERE CASE WHEN r LIKE '%:ok' THEN n * 2 >= pair_count ELSE n * 3 >= greatest(3, pair_count) END GROUP BY 1, 2),
{_rollup('pass', 'g', listing)},
named AS (SELECT DISTINCT g, query_id, product_id FROM pass),
whole AS (SELECT * FROM groups JOIN named USING (g) JOIN best USING (query_id, product_id) LEFT JOIN agg USING (query_id, product_id) LEFT JOIN wh USING (query_id, product_id))
SELECT query_id, sort, row_number() OVER (PARTITION BY query_id ORDER BY {group}, group_position) AS place, product_id, relevance, cheapest_listing,
       fastest_listing, listing_count, store_count, marketplaces, confidence, pair_count, text, attribute, image, reasons FROM whole"""


def _search() -> dict[str, str]:
    title = _first_option("nt", vocab.COLOURS)
    attrs = f"concat_ws(' ', title, lower(brand), lower(category), {_case(title, vocab.COLOUR_ALIASES, title)}, p_size)"
    results = f"""WITH {OFFERS},
norm AS (SELECT title, brand, category, p_size, {_normalize("title || ' '")} AS nt FROM (SELECT DISTINCT title, brand, category, p_size FROM l)),
st AS (SELECT title, brand, category, p_size, array_to_string({_tokens(_normalize(attrs))}, ' ') AS text FROM norm),
lt AS (SELECT l.*, st.text FROM l JOIN st USING (title, brand, category, p_size)),
texts AS (SELECT text, count(*) AS copies FROM lt GROUP BY text),
qs AS (SELECT p_name || ' ' || p_type AS query, p_name || ' ' || p_type AS query_id, max(p_size) AS z FROM part GROUP BY 1),
{_coverage('qs', 'texts')},
found AS (SELECT h.query_id, lt.*, round(coverage + 0.05 * least(1.0, review_count / 10000), 4) AS relevance FROM hits h JOIN lt USING (text)),
pass AS (
  SELECT f.*, f.query_id || chr(1) || f.product_id AS g FROM found f JOIN qs USING (query_id)
  WHERE (z % 2 <> 0 OR price <= 50000) AND (z % 3 <> 0 OR delivery_days <= 4) AND rating >= 1.5 AND (z % 5 <> 0 OR availability <> 'out_of_stock')),
best AS (SELECT query_id, product_id, round(max(relevance), 3) AS relevance FROM found GROUP BY 1, 2),
{_rollup('pass', 'g', 'relevance DESC, rating DESC')},
named AS (SELECT DISTINCT g, query_id, product_id FROM pass)"""
    history = """
ev AS (SELECT CASE WHEN user_id % 3 = 0 THEN upper(event_type[1]) || event_type[2:] ELSE event_type END || ' ' || (user_id % 4) AS query, ts FROM events),
late AS (SELECT query, ts, lower(query) AS low FROM ev ORDER BY ts DESC, query LIMIT 50),
plain AS (SELECT low, max(ts) AS shown FROM late WHERE query = low AND contains(low, 'i') GROUP BY low),
hist AS (SELECT query AS text, row_number() OVER (ORDER BY ts DESC, query) AS place FROM late LEFT JOIN plain USING (low)
         WHERE contains(low, 'i') AND (shown IS NULL OR ts > shown OR (query = low AND ts = shown)) ORDER BY place LIMIT 5),
prod AS (SELECT p_name || ' ' || p_brand || ' size ' || p_size AS text, p_partkey FROM part),
few AS (SELECT text, row_number() OVER (ORDER BY text, p_partkey) AS place FROM prod WHERE contains(lower(text), 'gear brand#1') ORDER BY place LIMIT 8)"""
    return {
        "search_coverage": f"""WITH docs AS (SELECT doc_id, array_to_string({_tokens(_normalize('text'))}, ' ') AS text FROM documents),
texts AS (SELECT text, count(*) AS copies FROM docs GROUP BY text),
qs AS (SELECT CAST(item_id AS VARCHAR) AS query_id, text AS query FROM benchmark),
{_coverage('qs', 'texts')}
SELECT query_id, doc_id, round(coverage, 6) AS coverage FROM hits JOIN docs USING (text)""",
        "search_results": f"""{results} SELECT query_id, product_id, relevance, {_ROLLUP} FROM groups JOIN named USING (g) JOIN best USING (query_id, product_id)""",
        "search_totals": f"""{results} SELECT query_id, count(*) AS total_groups, CAST(sum(listing_count) AS BIGINT) AS total_listings FROM groups JOIN named USING (g) GROUP BY 1""",
        "search_pages": _search_pages(),
        "suggestions": f"""WITH {history},
allof AS (SELECT text, 0 AS src, place FROM hist UNION ALL SELECT text, 1, place FROM few WHERE text NOT IN (SELECT text FROM hist))
SELECT text, row_number() OVER (ORDER BY src, place) AS place FROM (SELECT * FROM allof ORDER BY src, place LIMIT 8)""",
    }


# --- stores, delivery, places, feeds ---------------------------------------------------------


def _store(source: str, name: str = "stored") -> str:
    """CTE ``stored``: ``source`` rows (column ``source``) with listed_slug, store_slug, store_name, store_colour."""
    slug = {a: row[0] for a, row in vocab.STORE_ALIASES.items()}
    listed = lambda c: f"CASE WHEN {c} NOT IN {_in(vocab.AMBIGUOUS_STORE_WORDS)} THEN {_case(c, slug)} END"
    names = {slug: name for _, slug, name, _ in vocab.STORES}
    colours = {slug: colour for _, slug, _, colour in vocab.STORES}
    return f"""
{name}1 AS (SELECT *, trim(regexp_replace(regexp_replace(lower(trim(regexp_replace(trim(coalesce(source, '')), '(?s)\\s+[-–|]\\s+.*$', ''))),
            '^(www|buy|shop|store|m)\\.', ''), '\\.(com|in|co\\.in|shop|store)$', '')) AS key_ FROM {source}),
{name}2 AS (SELECT *, string_split(key_, ' ')[1] AS one_, array_to_string(string_split(key_, ' ')[1:2], ' ') AS two_ FROM {name}1),
{name}3 AS (SELECT *, coalesce({_case('key_', slug)}, {listed('two_')}, {listed('one_')},
            CASE WHEN regexp_matches(key_, '^(apple|samsung) .*(store|shop|india)$') THEN {_case('one_', slug)} END) AS listed_slug FROM {name}2),
{name} AS (SELECT * EXCLUDE (key_, one_, two_),
            coalesce(listed_slug, nullif(trim(regexp_replace(coalesce(nullif(key_, ''), 'store'), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'store') AS store_slug,
            coalesce({_case('listed_slug', names)}, trim(coalesce(nullif(source, ''), 'Store'))) AS store_name,
            {_case('listed_slug', colours, _q(vocab.OTHER_STORE_COLOUR))} AS store_colour FROM {name}3)"""


def _days(source: str, line: str, name: str = "timed") -> str:
    """CTE ``timed``: ``source`` rows with delivery_days read from column ``line``."""
    months = "|".join(vocab.MONTHS)
    first, second = rf"\b(\d{{1,2}})\s*({months})", rf"\b({months})[a-z]*\s*(\d{{1,2}})\b"
    number = {m: str(i + 1) for i, m in enumerate(vocab.MONTHS)}
    in_days = r"(\d+)\s*(?:-|to)?\s*(\d+)?\s*(?:business\s+|working\s+)?days?"
    weekday = "CASE " + " ".join(rf"WHEN regexp_matches(t_, '\b{d}') THEN {i}" for i, d in enumerate(vocab.WEEKDAYS)) + " END"
    ahead = f"(({weekday}) - (isodow({AS_OF}) - 1) + 7) % 7"
    made = lambda year: f"TRY_CAST(({year}) || '-' || lpad(mon_, 2, '0') || '-' || lpad(day_, 2, '0') AS DATE)"
    return f"""
{name}1 AS (SELECT *, lower(trim(coalesce({line}, ''))) AS t_ FROM {source}),
{name}2 AS (SELECT *, CASE WHEN regexp_matches(t_, {_q(first)}) THEN regexp_extract(t_, {_q(first)}, 1) ELSE regexp_extract(t_, {_q(second)}, 2) END AS day_,
            {_case(f"CASE WHEN regexp_matches(t_, {_q(first)}) THEN regexp_extract(t_, {_q(first)}, 2) ELSE regexp_extract(t_, {_q(second)}, 1) END", number)} AS mon_ FROM {name}1),
{name}3 AS (SELECT *, {made(f"year({AS_OF})")} AS d0_, {made(f"year({AS_OF}) + 1")} AS d1_ FROM {name}2),
{name} AS (SELECT * EXCLUDE (t_, day_, mon_, d0_, d1_), CAST(CASE
    WHEN t_ = '' THEN 99
    WHEN regexp_matches(t_, '\\b\\d+\\s*(min|mins|minutes|hr|hrs|hour|hours)\\b') OR contains(t_, 'today') OR contains(t_, 'same day') THEN 0
    WHEN contains(t_, 'tomorrow') OR contains(t_, 'next day') THEN 1
    WHEN regexp_matches(t_, {_q(in_days)}) THEN CAST(coalesce(nullif(regexp_extract(t_, {_q(in_days)}, 2), ''), regexp_extract(t_, {_q(in_days)}, 1)) AS INTEGER)
    WHEN d0_ >= {AS_OF} THEN date_diff('day', {AS_OF}, d0_)
    WHEN d0_ IS NOT NULL AND d1_ IS NOT NULL THEN date_diff('day', {AS_OF}, d1_)
    WHEN {weekday} IS NOT NULL THEN CASE WHEN {ahead} = 0 THEN 7 ELSE {ahead} END
    ELSE 99 END AS INTEGER) AS delivery_days FROM {name}3)"""


SHOPPING = f"""
rows_ AS (
  SELECT p_name || ' s' || p_size AS query_id, p AS product_key, CAST((p * 31 + s * 7) % 1000 + 1 AS INTEGER) AS position, p, s,
         {_pick(derived.BRAND_WORDS, 'p')} || ' ' || p_name || ' S' || p_size || CASE WHEN s % 4 = 0 THEN ' Pro' WHEN s % 4 = 1 THEN ' 5G' ELSE '' END
         || {_pick(derived.TITLE_FACTS, 'p + s')} || CASE WHEN (p + s) % 17 = 0 THEN ' - Refurbished' ELSE '' END
         || CASE WHEN (p + 2 * s) % 19 = 0 THEN ' Case' ELSE '' END || CASE WHEN s % 10 = 0 THEN ' | free delivery' ELSE '' END AS title,
         {_pick(derived.STORE_NAMES, 's')} AS source, 10000 + (p % 50) * 100 + (s % 7) * 700 AS rupees, rating, review_count,
         {_pick(derived.DELIVERY_TEXTS, 'p + s')} AS delivery FROM l),
priced AS (SELECT *, rupees + CASE WHEN (p + s) % 23 = 0 THEN 0.14 ELSE 0 END AS price_, CASE WHEN (p + s) % 29 = 0 THEN '$' ELSE '₹' END AS sign FROM rows_)
"""


def _feed() -> str:
    return f"""WITH {OFFERS}, {SHOPPING}, {_store('priced')},
ok AS (SELECT * FROM stored WHERE listed_slug IS NOT NULL AND sign = '₹' AND (p + s) % 23 <> 0),
{_days('ok', 'delivery')},
fs AS (SELECT query_id, 'g-' || CASE WHEN p % 4 <> 0 THEN 'pid' || p ELSE substring(md5(title || source), 1, 16) END || '-' || store_slug || '-' || substring(md5(lower(title)), 1, 8) AS listing_id,
  store_slug AS marketplace, source AS seller_name, title, CAST(price_ AS DOUBLE) AS price,
  CAST(CASE WHEN p % 3 = 0 THEN rupees + 500 ELSE rupees END AS DOUBLE) AS mrp, rating,
  CASE WHEN s % 5 = 0 THEN 0 ELSE review_count END AS review_count, delivery_days,
  CASE WHEN delivery = '' THEN 'See store for delivery' ELSE delivery END AS delivery_text, CAST(position AS DOUBLE) AS position,
  CASE WHEN s % 3 = 0 THEN 'tok' || s ELSE 'q' || s END AS page_token, '' AS product_url, p, s FROM timed)"""


def _stores() -> dict[str, str]:
    feed_columns = """query_id, listing_id, marketplace, seller_name, title, price, mrp, rating, review_count, delivery_days,
delivery_text, position, page_token, product_url"""
    url = _case("marketplace", vocab.STORE_SEARCH_URLS, _q(vocab.ANY_STORE_SEARCH_URL))
    quoted = "replace(replace(replace(replace(array_to_string(string_split(regexp_replace(trim(title), '\\s+', ' ', 'g'), ' ')[1:8], ' '), '(', '%28'), ')', '%29'), ',', '%2C'), '|', '%7C')"
    return {
        "store_resolution": f"""WITH named AS (SELECT s_suppkey, {_pick(derived.STORE_NAMES, 's_suppkey')} || CASE WHEN s_suppkey % 4 = 3 THEN ' India' ELSE '' END AS source FROM supplier),
{_store('named')} SELECT s_suppkey, source, listed_slug, store_slug, store_name, store_colour FROM stored""",
        "delivery_parse": f"""WITH told AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Delivery by ' || strftime(o_orderdate, '%-d %b')
  WHEN o_orderkey % 3 = 1 THEN 'Arrives ' || strftime(o_orderdate, '%A, %B %-d') ELSE {_pick(derived.DELIVERY_TEXTS, 'o_orderkey')} END AS line FROM orders),
{_days('told', 'line')} SELECT o_orderkey, line, delivery_days FROM timed""",
        "locations": f"""WITH c AS (SELECT c_custkey, left(CAST(100000 + c_custkey * 37 AS VARCHAR), 3) || CASE WHEN c_custkey % 4 = 0 THEN '12' ELSE '123' END AS pin,
  lower({_pick(["Bangalore", "Gurgaon", "Pune", "Bombay", "Trivandrum"], 'c_custkey')}) AS name FROM customer)
SELECT c_custkey, CASE WHEN length(pin) = 6 THEN pin END AS pincode, {_case('name', vocab.CITY_ALIASES, 'name')} AS city FROM c""",
        "feed_shopping": f"{_feed()} SELECT {feed_columns} FROM fs",
        "store_links": f"""{_feed()} SELECT DISTINCT query_id, listing_id, CASE WHEN CAST(position AS INTEGER) % 3 = 0 THEN 'https://shop.example/p/' || p
  ELSE replace({url}, '{{q}}', replace({quoted}, ' ', '+')) END AS link FROM fs""",
        "feed_marketplace": f"""WITH {OFFERS}, {SHOPPING},
own AS (SELECT * FROM priced WHERE position % 11 <> 0),
linked AS (SELECT *, CASE WHEN position % 2 = 0 THEN 'https://m.example/c/' || position WHEN position % 7 <> 0 THEN 'https://m.example/d/' || position ELSE '' END AS link,
  CASE WHEN contains(lower(delivery), 'deliver') OR contains(lower(delivery), 'get it') THEN delivery ELSE 'Or get it Today' END AS line FROM own),
ok AS (SELECT * FROM linked WHERE link <> '' AND (p + s) % 23 <> 0), {_days('ok', 'line')}
SELECT query_id, 'a-' || CASE WHEN position % 3 <> 0 THEN 'B0' || p || 'X' || position ELSE substring(md5(title), 1, 10) END AS listing_id, 'amazon' AS marketplace,
  'Amazon.in' AS seller_name, title, CAST(price_ AS DOUBLE) AS price, CAST(CASE WHEN p % 3 = 0 THEN rupees + 500 ELSE rupees END AS DOUBLE) AS mrp, rating,
  CASE WHEN s % 5 = 0 THEN 0 ELSE review_count END AS review_count, delivery_days, line AS delivery_text, position + 0.5::DOUBLE AS position, '' AS page_token, link AS product_url FROM timed""",
    }


# --- identity ------------------------------------------------------------------------------------


def _rule_text(x: str) -> str:
    t = f"replace(replace(lower({x}), '’', ''''), 'é', 'e')"
    for pattern, to in [
        (r"(iphone|galaxy|pixel|redmi|note|ipad)(\d)", r"\1 \2"), (r"(\d+)\s*(gb|tb)\b", r"\1\2"), (r"\[[^\]]*\]", " "),
        (r'[()\[\],|/+–—:;!"*]', " "), (r"\s-\s|\s-|-\s", " "), (r"\s+", " "),
    ]:
        t = f"regexp_replace({t}, {_q(pattern)}, {_q(to)}, 'g')"
    return f"trim({t})"


def _identity(source: str, title: str, n: str) -> str:
    """CTE ``n``: ``source`` rows with n_brand, n_model, n_family, n_storage, n_ram, n_colour, n_condition, n_quantity, n_guess, n_words, n_acc, n_spare."""
    colour = r"\b(" + "|".join(sorted(vocab.RULE_COLOURS, key=len, reverse=True)) + r")\b"
    ram = r"\b(\d{1,2})gb\s*ram\b|\bram\s*(\d{1,2})gb\b"
    amount = r"\b(\d+(?:\.\d+)?)\s?(ml|l|g|kg|mah|w|inch|cm)\b"
    plain = r"regexp_replace(t_, '\b[2-5]g\b', ' ', 'g')"
    qty = f"regexp_extract({plain}, {_q(amount)}, 1) || regexp_extract({plain}, {_q(amount)}, 2)"
    implied = "ram0_ IS NULL AND len(sizes_) >= 2 AND sizes_[1].v <= 24"
    model = f"regexp_matches(w, '[0-9]') OR w IN {_in(vocab.RULE_VARIANT_WORDS)}"
    brand = f"coalesce(list_filter(words_[1:3], lambda w: w IN {_in(vocab.RULE_BRANDS)})[1], {_case(f'list_filter(words_, lambda w: w IN {_in(vocab.RULE_BRAND_WORDS)})[1]', vocab.RULE_BRAND_WORDS)})"
    return f"""
{n}1 AS (SELECT *, {_rule_text(title)} AS t_, {_rule_text(f"string_split({title}, '|')[1]")} AS h_ FROM {source}),
{n}2 AS (SELECT * REPLACE (CASE WHEN h_ = '' THEN t_ ELSE h_ END AS h_) FROM {n}1),
{n}3 AS (SELECT *, list_filter(string_split(h_, ' '), lambda w: w <> '') AS words_, regexp_extract_all(t_, {_q(colour)}, 1) AS cols_,
         nullif(regexp_extract(t_, {_q(ram)}, 1) || regexp_extract(t_, {_q(ram)}, 2), '') || 'gb' AS ram0_ FROM {n}2),
{n}4 AS (SELECT *, list_filter(list_sort([{{'v': CAST(regexp_extract(m, '[0-9.]+') AS DOUBLE) * CASE WHEN right(m, 2) = 'tb' THEN 1024 ELSE 1 END, 'n': m}}
         FOR m IN regexp_extract_all(t_, '\\b(?:[0-9]+(?:\\.[0-9]+)?)(?:gb|tb)\\b')]), lambda z: ram0_ IS NULL OR z.n <> ram0_) AS sizes_, {brand} AS b_ FROM {n}3),
{n}5 AS (SELECT *, {_case('b_', vocab.RULE_BRAND_FOLDS, 'b_')} AS {n}_brand FROM {n}4),
{n}6 AS (SELECT *, list_filter(list_transform(words_, lambda w: trim(w, '.''')), lambda w: w <> '' AND w NOT IN {_in(vocab.RULE_FILLER_WORDS)}
         AND NOT list_contains(string_split(array_to_string(cols_, ' '), ' '), w) AND w IS DISTINCT FROM {n}_brand
         AND NOT regexp_matches(w, '^([0-9]+(\\.[0-9]+)?(gb|tb)|5g|4g)$') AND NOT regexp_matches(w, '[0-9]{{5,}}')) AS tell_ FROM {n}5),
{n} AS (SELECT * EXCLUDE (t_, h_, words_, cols_, ram0_, sizes_, b_, tell_),
         list_sort(list_distinct(list_filter(tell_, lambda w: {model}))) AS {n}_model,
         list_sort(list_distinct(list_filter(tell_, lambda w: NOT ({model}) AND length(w) > 1))) AS {n}_family,
         CASE WHEN {implied} THEN sizes_[2:][-1].n ELSE sizes_[-1].n END AS {n}_storage,
         CASE WHEN ram0_ IS NOT NULL THEN ram0_ WHEN {implied} THEN sizes_[1].n END AS {n}_ram,
         replace(cols_[-1], 'gray', 'grey') AS {n}_colour,
         CASE WHEN regexp_matches(t_, {_q(vocab.CONDITION_PATTERN)}) THEN 'refurbished' ELSE 'new' END AS {n}_condition,
         CASE WHEN {qty} NOT IN ('', '2g', '3g', '4g', '5g') THEN {qty} END AS {n}_quantity,
         coalesce({n}_brand, CASE WHEN length(words_[1]) > 1 AND NOT regexp_matches(words_[1], '^[0-9]') THEN words_[1] END) AS {n}_guess,
         words_ AS {n}_words, list_has_any(tell_, {list(vocab.RULE_ACCESSORY_WORDS)}) AS {n}_acc,
         regexp_matches(h_, {_q(vocab.SPARE_PATTERN)}) OR starts_with(h_, 'for ')
           OR (regexp_matches(h_, '\\b(display|screen)\\b') AND NOT regexp_matches(t_, '[0-9]+\\s?(gb|tb)\\b')) AS {n}_spare FROM {n}6)"""


def _accessory(n: str, words: str) -> str:
    return (
        f"(({n}_acc AND NOT list_has_any({words}, {list(vocab.RULE_ACCESSORY_WORDS)})) "
        f"OR ({n}_spare AND NOT list_has_any({words}, {list(vocab.SPARE_QUERY_WORDS)})))"
    )


def _rules() -> dict[str, str]:
    words = f"list_filter(string_split({_rule_text('query')}, ' '), lambda w: w <> '')"
    extra = (
        f"len(list_filter(i_model, lambda m: NOT list_contains(q_model, m) AND (m IN {_in(vocab.RULE_VARIANT_WORDS)} OR m = 'e' "
        "OR len(list_filter(q_model, lambda x: x <> m AND starts_with(m, x) AND regexp_matches(x, '^[0-9]+$'))) > 0)))"
    )
    return {
        "title_identity": f"""WITH {OFFERS}, {SHOPPING}, d AS (SELECT DISTINCT title, query_id AS query FROM priced), {_identity('d', 'title', 'i')}
SELECT title, query, i_brand AS brand, array_to_string(i_model, ' ') AS model, array_to_string(i_family, ' ') AS family, i_storage AS storage, i_ram AS ram,
       i_colour AS colour, i_condition AS condition, i_quantity AS quantity, i_guess AS brand_guess, {_accessory('i', words)} AS accessory FROM i""",
        "rule_relevance": f"""{_feed()},
g AS (SELECT query_id, title AS canonical_title, min(CASE WHEN CAST(position AS INTEGER) % 9 = 0 THEN price / 4 ELSE price END) AS price_min,
             count(DISTINCT marketplace) AS n_stores FROM fs GROUP BY 1, 2),
ranked AS (SELECT query_id, price_min, row_number() OVER (PARTITION BY query_id ORDER BY price_min) - 1 AS k, count(*) OVER (PARTITION BY query_id) AS n FROM g),
med AS (SELECT query_id, price_min AS median FROM ranked WHERE k = n // 2),
qd AS (SELECT DISTINCT query_id, query_id AS query FROM g), {_identity('qd', 'query', 'q')}, {_identity('g', 'canonical_title', 'i')},
x AS (SELECT i.*, q.* EXCLUDE (query_id), median, {words} AS qwords,
             list_distinct(list_concat(q_model, q_family)) AS want, list_distinct(list_concat(i_model, i_family)) AS have
      FROM i JOIN q USING (query_id) JOIN med USING (query_id)),
y AS (SELECT *, len(list_intersect(want, have)) + CASE WHEN q_storage = i_storage THEN 1 ELSE 0 END AS hit,
             len(want) + CASE WHEN q_storage IS NULL THEN 0 ELSE 1 END AS total, {extra} AS extra,
             q_brand IS NOT NULL AND i_guess IS DISTINCT FROM q_brand AS wrong,
             i_condition = 'refurbished' AND NOT list_has_any(string_split(lower(query), ' '), {list(vocab.REFURBISHED_QUERY_WORDS)}) AS refurb,
             {_accessory('i', 'qwords')} AS acc, price_min < 0.4 * median AS cheap FROM x)
SELECT query_id, canonical_title, price_min,
       round(CASE WHEN total > 0 THEN hit / total ELSE 0.5 END - 0.2 * extra - CASE WHEN wrong THEN 0.6 ELSE 0 END - CASE WHEN refurb THEN 0.25 ELSE 0 END
             - CASE WHEN acc THEN 0.6 ELSE 0 END - CASE WHEN cheap THEN 0.9 ELSE 0 END + 0.05 * (n_stores - 1), 3) AS relevance,
       concat_ws(',', CASE WHEN refurb THEN 'refurbished' END, CASE WHEN acc THEN 'accessory' END, CASE WHEN cheap THEN 'unusually_low_price' END) AS flags FROM y""",
    }


# --- rule groups ---------------------------------------------------------------------------------


def _grouped() -> str:
    """CTE ``kept``: one offer per store and group, by the ordered pass row after row; ``numbered`` holds all listings."""
    words = f"list_filter(string_split({_rule_text('query')}, ' '), lambda w: w <> '')"
    clash = " OR ".join(f"coalesce(a.i_{f} <> b.i_{f}, false)" for f in ("brand", "storage", "ram", "colour", "quantity"))
    same = "len(list_intersect(a.i_family, b.i_family))"
    speaks = " OR ".join(f"{x}.i_{f} IS NOT NULL" for x in "ab" for f in ("storage", "colour", "quantity"))
    return f"""{_feed().replace("WITH ", "WITH RECURSIVE ", 1)},
m_own AS (SELECT * FROM priced WHERE position % 11 <> 0),
m_linked AS (SELECT *, CASE WHEN position % 2 = 0 THEN 'c' WHEN position % 7 <> 0 THEN 'd' ELSE '' END AS link,
  CASE WHEN contains(lower(delivery), 'deliver') OR contains(lower(delivery), 'get it') THEN delivery ELSE 'Or get it Today' END AS line FROM m_own),
m_ok AS (SELECT * FROM m_linked WHERE link <> '' AND (p + s) % 23 <> 0), {_days('m_ok', 'line', 'm_timed')},
raws AS (
  SELECT query_id, listing_id, marketplace, title, price, position, delivery_days, false AS direct FROM fs
  UNION ALL
  SELECT query_id, 'a-' || CASE WHEN position % 3 <> 0 THEN 'B0' || p || 'X' || position ELSE substring(md5(title), 1, 10) END, 'amazon', title,
         CAST(price_ AS DOUBLE), position + 0.5::DOUBLE, delivery_days, true FROM m_timed),
u AS (SELECT *, query_id AS query FROM raws QUALIFY row_number() OVER (PARTITION BY query_id, listing_id ORDER BY position, price, title, delivery_days) = 1),
{_identity('u', 'title', 'i')},
said AS (SELECT *, {_accessory('i', words)} AS acc, (i_storage IS NOT NULL)::INT + (i_ram IS NOT NULL)::INT + (i_colour IS NOT NULL)::INT + (i_quantity IS NOT NULL)::INT AS spec FROM i),
numbered AS (SELECT *, concat_ws('|', query_id, array_to_string(i_model, ' '), i_condition, acc::VARCHAR) AS block,
  row_number() OVER (PARTITION BY query_id, i_model, i_condition, acc ORDER BY spec DESC, position, listing_id) AS k FROM said),
fit AS (SELECT b.block, b.k, list(a.k) AS nb FROM numbered a JOIN numbered b ON a.block = b.block AND a.k < b.k
  WHERE NOT ({clash}) AND greatest(a.price, b.price) / greatest(1.0, least(a.price, b.price)) <= CASE WHEN {speaks} THEN 1.6 ELSE 1.15 END
    AND CASE WHEN len(a.i_model) = 0 THEN {same} > 0 AND 2 * {same} / (len(a.i_family) + len(b.i_family)) >= 0.75
             ELSE {same} > 0 OR len(a.i_family) = 0 OR len(b.i_family) = 0 END
  GROUP BY 1, 2),
steps AS (SELECT n.block, n.k, n.price, n.spec, coalesce(f.nb, []::BIGINT[]) AS nb FROM numbered n LEFT JOIN fit f ON n.block = f.block AND n.k = f.k),
walk AS (
  SELECT block, k, [{{'m': [k], 'lo': price}}] AS cl FROM steps WHERE k = 1
  UNION ALL
  SELECT block, k, CASE WHEN len(opts) > 0 THEN list_transform(cl, lambda x, i: CASE WHEN i = opts[1] THEN {{'m': list_append(x.m, k), 'lo': least(x.lo, price)}} ELSE x END)
                        ELSE list_append(cl, {{'m': [k], 'lo': price}}) END
  FROM (SELECT block, k, price, cl, CASE WHEN spec > 0 OR len(fits) < 2 THEN fits WHEN len(near) = 1 THEN near ELSE [] END AS opts
        FROM (SELECT *, list_filter(fits, lambda i: abs(price - cl[i].lo) / greatest(1.0, price) <= 0.05) AS near
              FROM (SELECT s.*, w.cl, list_filter(range(1, len(w.cl) + 1), lambda i: list_has_all(s.nb, w.cl[i].m)) AS fits
                    FROM walk w JOIN steps s ON s.block = w.block AND s.k = w.k + 1)))),
last_ AS (SELECT block, cl FROM walk QUALIFY row_number() OVER (PARTITION BY block ORDER BY k DESC) = 1),
ends_ AS (SELECT block, unnest(cl).m AS m FROM last_),
member AS (SELECT block, m[1] AS opener, unnest(m) AS k FROM ends_),
placed AS (SELECT n.*, o.listing_id AS group_id FROM member JOIN numbered n USING (block, k) JOIN numbered o ON o.block = member.block AND o.k = opener),
kept AS (SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY query_id, group_id, marketplace ORDER BY price, spec DESC, position, listing_id) = 1)"""


def _rule_pages() -> dict[str, str]:
    def fact(f: str, label: str, name: str) -> str:
        a, b = f"a.i_{f}", f"b.i_{f}"
        return (f"CASE WHEN {a} = {b} THEN 'Same {label}:ok' WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN '{name} differs (' || {a} || ' vs ' || {b} || '):warn' "
                f"WHEN coalesce({a}, {b}) IS NOT NULL THEN '{name} not stated on one listing:info' END")

    dice = "CASE WHEN len(a.i_family) > 0 AND len(b.i_family) > 0 THEN 2 * len(list_intersect(a.i_family, b.i_family)) / (len(a.i_family) + len(b.i_family)) ELSE 0.0 END"
    ratio = "(greatest(a.price, b.price) / greatest(1.0, least(a.price, b.price)))"
    sized = lambda x: f"CASE WHEN regexp_matches({x}, '[0-9](gb|tb)$') THEN left({x}, -2) || ' ' || upper(right({x}, 2)) ELSE {x} END"
    words = f"list_filter(string_split({_rule_text('query')}, ' '), lambda w: w <> '')"
    extra = (
        f"len(list_filter(g_model, lambda m: NOT list_contains(q_model, m) AND (m IN {_in(vocab.RULE_VARIANT_WORDS)} OR m = 'e' "
        "OR len(list_filter(q_model, lambda x: x <> m AND starts_with(m, x) AND regexp_matches(x, '^[0-9]+$'))) > 0)))"
    )
    return {
        "rule_groups": f"{_grouped()} SELECT query_id, group_id, listing_id, marketplace, price FROM kept",
        "rule_pairs": f"""{_grouped()}
SELECT a.query_id, a.group_id, a.listing_id AS listing_id_a, b.listing_id AS listing_id_b, round({dice}, 4) AS text_score, 0.0::DOUBLE AS image_score, 1.0::DOUBLE AS attribute_score,
  least(0.99, round(0.55 + 0.25 * least(1.0, {dice} + 0.3) + 0.2 * (1 - ({ratio} - 1) / (1.6 - 1 + 1e-9)), 4))::DOUBLE AS combined_score, 'EXACT_MATCH' AS match_type,
  concat_ws(';', {fact('brand', 'brand', 'Brand')}, CASE WHEN len(a.i_model) > 0 THEN 'Same model (' || array_to_string(a.i_model, ' ') || '):ok' END, {fact('storage', 'storage', 'Storage')},
    {fact('ram', 'RAM', 'Ram')}, {fact('colour', 'colour', 'Colour')}, {fact('quantity', 'size/quantity', 'Size/quantity')}, 'Both ' || a.i_condition || ':ok', 'Prices consistent:ok') AS reasons
FROM kept a JOIN kept b ON a.query_id = b.query_id AND a.group_id = b.group_id AND (-a.spec, a.position, a.listing_id) < (-b.spec, b.position, b.listing_id)""",
        "rule_results": f"""{_grouped()},
led AS (SELECT *, first_value(listing_id) OVER (PARTITION BY query_id, group_id ORDER BY position, price, listing_id) = listing_id AS lead FROM kept),
grp AS (SELECT query_id, query_id AS query, group_id, min(price) AS price_min, max(price) AS price_max, count(*) AS listing_count, list_sort(list(marketplace)) AS stores,
          min(delivery_days) FILTER (WHERE delivery_days < 90) AS fastest_days, min({{'f': direct, 'p': position, 'i': listing_id}}) AS rank,
          max(title) FILTER (WHERE lead) AS lead_title, max(i_brand) FILTER (WHERE lead) AS l_brand, max(i_storage) FILTER (WHERE lead) AS l_storage, max(i_ram) FILTER (WHERE lead) AS l_ram,
          max(i_colour) FILTER (WHERE lead) AS l_colour, max(i_condition) FILTER (WHERE lead) AS l_condition, max(i_quantity) FILTER (WHERE lead) AS l_quantity FROM led GROUP BY ALL),
shown AS (SELECT *, trim(regexp_replace(regexp_replace(lead_title, '\\s*\\[[^\\]]*\\]\\s*', ' ', 'g'), '\\s+', ' ', 'g'), ' -|,') AS canonical_title FROM grp),
ranked AS (SELECT query_id, price_min, row_number() OVER (PARTITION BY query_id ORDER BY price_min) - 1 AS r, count(*) OVER (PARTITION BY query_id) AS n FROM shown WHERE price_min <> 0),
med AS (SELECT query_id, price_min AS median FROM ranked WHERE r = n // 2),
qd AS (SELECT DISTINCT query_id, query FROM shown), {_identity('qd', 'query', 'q')}, {_identity('shown', 'canonical_title', 'g')},
x AS (SELECT g.*, q.* EXCLUDE (query_id, query), median, {words.replace('query', 'g.query')} AS qwords,
        list_distinct(list_concat(q_model, q_family)) AS want, list_distinct(list_concat(g_model, g_family)) AS have
      FROM g JOIN q USING (query_id) JOIN med USING (query_id)),
y AS (SELECT *, len(list_intersect(want, have)) + CASE WHEN q_storage = g_storage THEN 1 ELSE 0 END AS hit, len(want) + CASE WHEN q_storage IS NULL THEN 0 ELSE 1 END AS total,
        {extra} AS extra, q_brand IS NOT NULL AND g_guess IS DISTINCT FROM q_brand AS wrong,
        g_condition = 'refurbished' AND NOT list_has_any(string_split(lower(query), ' '), {list(vocab.REFURBISHED_QUERY_WORDS)}) AS refurb,
        {_accessory('g', 'qwords')} AS part, price_min < 0.4 * median AS cheap FROM x),
z AS (SELECT *, round(CASE WHEN total > 0 THEN hit / total ELSE 0.5 END - 0.2 * extra - CASE WHEN wrong THEN 0.6 ELSE 0 END - CASE WHEN refurb THEN 0.25 ELSE 0 END
        - CASE WHEN part THEN 0.6 ELSE 0 END - CASE WHEN cheap THEN 0.9 ELSE 0 END + 0.05 * (len(stores) - 1), 3) AS relevance FROM y),
plain AS (SELECT * FROM z WHERE NOT (refurb OR part OR cheap)),
known AS (SELECT * FROM plain QUALIFY fastest_days IS NOT NULL OR count(fastest_days) OVER (PARTITION BY query_id) = 0),
strong AS (SELECT * FROM known QUALIFY relevance >= 0.5 OR count(*) FILTER (WHERE relevance >= 0.5) OVER (PARTITION BY query_id) < 3),
one AS (SELECT * FROM strong QUALIFY row_number() OVER (PARTITION BY query_id, trim(regexp_replace(lower(canonical_title), '[^a-z0-9]+', ' ', 'g')) ORDER BY -relevance, -len(stores), rank, group_id) = 1)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY -relevance, rank, -len(stores), group_id) AS place, canonical_title, relevance, price_min, price_max, listing_count, fastest_days,
  array_to_string(stores, ',') AS marketplaces,
  concat_ws(';', 'brand=' || l_brand, 'colour=' || l_colour, 'condition=' || nullif(l_condition, 'new'), 'quantity=' || l_quantity, 'ram=' || ({sized('l_ram')}) || ' RAM', 'storage=' || ({sized('l_storage')})) AS attributes
FROM one""",
    }


# --- ingest and enrichment --------------------------------------------------------------------------

_FRESH = """
fresh AS (SELECT CASE WHEN (p + s) % 3 = 0 THEN listing_id ELSE 'n-' || s || '-' || (p % 100) END AS listing_id, position, floor(price * 0.9) AS price, floor(mrp) AS mrp FROM l),
one AS (SELECT * FROM fresh QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY position) = 1),
new_ AS (SELECT *, CASE WHEN mrp > 0 THEN round(greatest(0, (mrp - price) / mrp * 100), 1) ELSE 0 END AS d FROM one)"""

_OFFER_ROWS = f"""
li AS (SELECT * REPLACE (CASE WHEN s % 2 = 0 THEN {_pick(derived.STORE_NAMES, 's')} ELSE seller_name END AS seller_name) FROM l),
so AS (SELECT product_id, p, s, s AS offer_order, {_pick(derived.STORE_NAMES, 'p + s')} AS source, CASE WHEN s % 3 = 0 THEN '' ELSE title || {_pick(derived.TITLE_FACTS, 's')} END AS title,
  CASE WHEN s % 9 <> 0 THEN 'https://store' || (s % 12) || '.example/p/' || p END AS link, CASE WHEN s % 8 = 0 THEN floor(price) + 0.5 ELSE floor(price) END AS price,
  CASE WHEN s % 2 = 0 THEN floor(price) + 900 ELSE CASE WHEN s % 8 = 0 THEN floor(price) + 0.5 ELSE floor(price) END END AS mrp,
  {_pick(derived.DELIVERY_TEXTS, 'p + 2 * s')} AS dl FROM l)"""


def _ingest() -> dict[str, str]:
    snaps = """
h AS (SELECT lower(trim(event_type)) || ' shoes|city' || user_id AS query_key, date_trunc('day', ts) AS day, event_id % 97 AS pid, min(value) AS r FROM events GROUP BY 1, 2, 3),
sn AS (SELECT query_key, day, list(pid ORDER BY r, pid) AS ids FROM h GROUP BY 1, 2),
cur AS (SELECT query_key, arg_max(ids, day) AS ids, max(day) AS day FROM sn GROUP BY 1)"""
    judged = f"""WITH {OFFERS}, {_OFFER_ROWS}, {_store('so')},
bs AS (SELECT product_id, first(title ORDER BY position, listing_id) AS base_title, min(price) AS low FROM li GROUP BY 1),
jo AS (SELECT * FROM stored JOIN bs USING (product_id)), {_identity('jo', 'title', 'o')}, {_identity('o', 'base_title', 'b')},
jd AS (SELECT *, CASE WHEN listed_slug IS NULL THEN 'store' WHEN coalesce(link, '') = '' OR price = 0 OR round(price, 2) <> round(price, 0) THEN 'link'
       WHEN greatest(price, low) / greatest(1, least(price, low)) > 1.6 THEN 'price'
       WHEN title <> '' AND (coalesce(o_storage <> b_storage, false) OR coalesce(o_ram <> b_ram, false) OR coalesce(o_colour <> b_colour, false) OR o_condition <> b_condition) THEN 'variant'
       ELSE 'ok' END AS verdict FROM b),
{_store("(SELECT product_id, position, listing_id, seller_name AS source FROM li)", "ls")}"""
    return {
        "upsert": f"""WITH {OFFERS}, {_FRESH}
SELECT l.listing_id, l.product_id, coalesce(n.price, l.price) AS price, coalesce(n.mrp, l.mrp) AS mrp, coalesce(n.d, l.discount_percentage) AS discount_percentage
FROM l LEFT JOIN new_ n USING (listing_id)
UNION ALL SELECT listing_id, NULL, price, mrp, d FROM new_ WHERE listing_id NOT IN (SELECT listing_id FROM l)""",
        "new_stores": f"""WITH {OFFERS}, {_OFFER_ROWS}, {_store('so')}, f AS (SELECT store_slug, min(store_name) AS name, min(link) AS link, min(store_colour) AS colour FROM stored GROUP BY 1)
SELECT store_slug AS slug, name, '' AS logo_url, coalesce('https://' || regexp_extract(link, '^https://([^/]+)', 1), '') AS base_url, colour AS brand_color
FROM f WHERE store_slug NOT IN ('amazon', 'croma')""",
        "snapshots": f"""WITH {snaps} SELECT query_key, array_to_string(ids, ',') AS product_ids, strftime(day, '%Y-%m-%d %H:%M:%S') AS fetched_at,
  day > TIMESTAMP '2024-01-29 22:00:00' AS fresh FROM cur""",
        "snapshot_asof": f"""WITH {snaps},
rq AS (SELECT event_id, lower(trim(event_type)) || ' shoes|city' || user_id AS query_key, ts, event_id % 5 = 0 AS failed FROM events),
tk AS (SELECT query_key, day + INTERVAL 12 HOUR AS taken, ids FROM sn),
bf AS (SELECT rq.*, taken, ids FROM rq ASOF LEFT JOIN tk ON rq.query_key = tk.query_key AND rq.ts >= tk.taken),
oc AS (SELECT *, CASE WHEN taken IS NOT NULL AND taken > ts - INTERVAL 6 HOUR THEN 'fresh' WHEN NOT failed THEN 'fetch' WHEN taken IS NOT NULL THEN 'stale' ELSE 'empty' END AS outcome FROM bf)
SELECT event_id, query_key, outcome, CASE WHEN outcome IN ('fresh', 'stale') THEN array_to_string(ids, ',') END AS product_ids,
       CASE WHEN outcome IN ('fresh', 'stale') THEN strftime(taken, '%Y-%m-%d %H:%M:%S') END AS fetched_at FROM oc""",
        "snapshot_products": f"""WITH {snaps}, e AS (SELECT query_key, unnest(ids) AS product_id, unnest(range(len(ids))) AS place FROM cur)
SELECT query_key, place, product_id, p_name FROM e JOIN part ON p_partkey = product_id""",
        "enrich_links": f"""{judged},
lastv AS (SELECT product_id, store_slug, arg_max(price, offer_order) AS price, arg_max(link, offer_order) AS link FROM jd WHERE verdict = 'ok' GROUP BY 1, 2),
fl AS (SELECT product_id, store_slug, first(listing_id ORDER BY position, listing_id) AS listing_id FROM ls GROUP BY 1, 2)
SELECT listing_id, v.price, li.mrp, v.link AS product_url FROM lastv v JOIN fl USING (product_id, store_slug) JOIN li USING (listing_id)""",
        "enrich_added": f"""{judged},
nw AS (SELECT * FROM jd WHERE verdict = 'ok' AND NOT EXISTS (SELECT 1 FROM ls WHERE ls.product_id = jd.product_id AND ls.store_slug = jd.store_slug)
       QUALIFY row_number() OVER (PARTITION BY product_id, store_slug ORDER BY offer_order) = 1),
ln AS (SELECT *, CASE WHEN regexp_matches(lower(dl), 'deliver|arrives|shipping') THEN dl ELSE 'Ships in 6 days' END AS line FROM nw), {_days('ln', 'line')}
SELECT 's-' || product_id || '-' || store_slug AS listing_id, product_id, store_slug AS marketplace, source AS seller_name, coalesce(nullif(title, ''), base_title) AS title,
       price, greatest(price, mrp) AS mrp, delivery_days, line AS delivery_text, link AS product_url FROM timed""",
        "enrich_notes": f"""{judged}, ks AS (SELECT DISTINCT product_id, store_slug, true AS known FROM ls),
j AS (SELECT jd.*, known FROM jd LEFT JOIN ks USING (product_id, store_slug))
SELECT product_id, count(*) AS offers, count(*) FILTER (WHERE verdict = 'ok' AND known) AS linked,
       count(DISTINCT store_slug) FILTER (WHERE verdict = 'ok' AND known IS NULL) AS added, count(*) FILTER (WHERE verdict = 'store') AS not_listed,
       count(*) FILTER (WHERE verdict = 'link') AS no_link, count(*) FILTER (WHERE verdict = 'price') AS price_far, count(*) FILTER (WHERE verdict = 'variant') AS other_variant
FROM j GROUP BY 1""",
    }


def registered() -> dict[str, str]:
    out = {**_offers(), **_text(), **_matching(), **_details(), **_search(), **_stores(), **_rules(), **_rule_pages(), **_ingest()}
    out["stream_upsert"] = out["upsert"]   # the streamed upsert must leave the same table
    out["stream_history"] = """SELECT DISTINCT event_type AS query, CAST(user_id AS VARCHAR) AS pincode,
strftime(time_bucket(INTERVAL '10 minutes', ts), '%Y-%m-%d %H:%M:%S') AS slot FROM events"""
    return out
