"""Crawling, deduplication, string functions, language identification and summarisation, each in both dialects."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.operators import languages, pairs, summaries
from lexweave.plans.dialect import MADE, add
from lexweave.plans.retrieval import DF, IDF, N, TF
from lexweave.sources.index import Index, merged

# --- pages -----------------------------------------------------------------------------------------------------------------
#: Named entities that are decoded, each once, the ampersand last.
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "#39": "''", "apos": "''", "nbsp": " ", "middot": "·", "copy": "©", "reg": "®", "mdash": "—", "ndash": "–", "hellip": "…", "laquo": "«", "raquo": "»", "amp": "&"}


def decoded(text: str) -> str:
    for name, sign in ENTITIES.items():
        text = f"replace({text}, '&{name};', '{sign}')" if sign != "''" else f"replace({text}, '&{name};', chr(39))"
    return text


VISIBLE = r"trim(@rr(@DECODED | '[ \t\r\n]+' | ' '))"
STRIPPED = r"@rr(@rr(@rr(html | '(?is)<(script\|style\|noscript\|template\|head)[^>]*>.*?</(script\|style\|noscript\|template\|head)>' | ' ') | '(?s)<!--.*?-->' | ' ') | '<[^>]*>' | ' ')".replace("\\|", "|")
VISIBLE = VISIBLE.replace("@DECODED", decoded(STRIPPED))
add("q_html_to_text", f"SELECT page_id, {VISIBLE} AS text FROM pages")
add("q_html_title", "SELECT page_id, trim(coalesce(nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), ''), regexp_extract(html, '<h1>([^<]*)</h1>', 1))) AS title FROM pages")
add("q_looks_html", "SELECT doc_id, @like(lower(substring(text, 1, 500)) | '<(html|body|p|div|!doctype)') AS html FROM documents UNION ALL SELECT -page_id - 1, @like(lower(substring(html, 1, 500)) | '<(html|body|p|div|!doctype)') FROM pages")
HOST = "lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1))"
add("q_url_host", f"SELECT page_id, {HOST} AS host, @rr({HOST} | '^www[.]' | '') AS site, @like(lower(url) | '[.](pdf|png|jpe?g|gif|zip|gz|css|js|xml)([?#]|$)') AS skipped FROM pages")
PARAMS = "(SELECT page_id, @each(@distinct(@all(url | '[?&]([^&#=]+=[^&#]*)' | 1))) AS p FROM pages)"
add("q_canonical_url", f"WITH q AS (SELECT page_id, @join(p | '&' | p) AS query FROM {PARAMS} x WHERE NOT @like(p | '^(utm_[a-z]+|ref|fbclid|gclid|sid)=') GROUP BY page_id) SELECT pages.page_id, concat(lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)), '://', {HOST}, coalesce(nullif(@rr(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*(/[^?#]*)', 1) | '/+$' | ''), ''), '/'), CASE WHEN query IS NULL THEN '' ELSE concat('?', query) END) AS url FROM pages LEFT JOIN q ON q.page_id = pages.page_id")
add("q_crawl_gate", "SELECT page_id, CASE WHEN @like(url | '[.](pdf|zip)$') THEN 'content_type' WHEN length(html) > 12000 THEN 'too_large' WHEN length(html) < 400 THEN 'too_short' END AS skip_reason FROM pages")
add("q_skip_breakdown", "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN url LIKE '%spam%' THEN 'host' WHEN length(html) > 12000 THEN 'too_large' WHEN length(html) < 400 THEN 'too_short' ELSE 'kept' END AS reason FROM pages) GROUP BY reason")
LINKS = f"links AS (SELECT DISTINCT page_id, {HOST} AS host, @each(@all(html | 'href=\"(/[^\"]*)\"' | 1)) AS path FROM pages)"
add("q_bfs_frontier", f"WITH {LINKS}, seed AS (SELECT host, '/' AS path, 0 AS depth, 0 AS priority FROM links), l1 AS (SELECT host, path, 1 AS depth, 100 AS priority FROM links WHERE path <> '/') SELECT host, path, min(depth) AS depth, min(priority) AS priority FROM (SELECT * FROM seed UNION ALL SELECT * FROM l1) GROUP BY host, path")
add("q_frontier_claim", f"WITH {LINKS}, f AS (SELECT host, path, min(page_id) AS id FROM links GROUP BY host, path) SELECT host, path, row_number() OVER (ORDER BY 100 + length(path), id, host, path) AS place FROM (SELECT * FROM f ORDER BY 100 + length(path), id, host, path LIMIT 50) q")
add("q_frontier_page", "SELECT page_id, url, total FROM (SELECT page_id, url, count(*) OVER () AS total, row_number() OVER (ORDER BY page_id) AS i FROM pages WHERE url LIKE 'https:%') WHERE i BETWEEN 11 AND 20")
add("q_clean_paragraphs", "WITH p AS (SELECT page_id, @each(@all(html | '<p>([^<]{40,})' | 1)) AS t FROM pages), c AS (SELECT page_id, trim(@rr(t | '\\[[0-9]+\\]' | '')) AS t FROM p) SELECT page_id, substring(t, 1, 120) AS lead, count(*) AS times FROM c WHERE length(t) - length(replace(t, '|', '')) <= 3 GROUP BY page_id, substring(t, 1, 120)")
# --- duplicates ------------------------------------------------------------------------------------------------------------
NORMAL = "trim(@rr(lower(text) | '[ \\t\\r\\n]+' | ' '))"
add("q_content_hash", f"SELECT doc_id, @sha({NORMAL}) AS hash FROM documents")
add("q_exact_duplicates", f"SELECT doc_id, first_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY @sha({NORMAL})) AS first_id FROM documents) WHERE doc_id <> first_id")
# 64 votes from two hashes of a term: it adds its frequency to a bit, or takes it away


def _bits(hashed: str, name: str) -> str:
    votes = " + ".join(f"CASE WHEN sum(CASE WHEN floor({hashed} / {2**i}e0) % 2 = 1 THEN tf ELSE -tf END) > 0 THEN {2**i}e0 ELSE 0e0 END" for i in range(32))
    return f"@long({votes}) AS {name}"


SIM = f"{TF}, hb AS (SELECT doc_id, tf, @hash(term) AS h, @hash(concat(term, '#')) AS g FROM tf), sim AS (SELECT doc_id, {_bits('h', 'high')}, {_bits('g', 'low')} FROM hb GROUP BY doc_id)"
APART = "@long(bit_count(@xor(a.high | b.high)) + bit_count(@xor(a.low | b.low)))"
add("q_simhash", f"WITH {SIM} SELECT doc_id, high, low FROM sim")
HAMMING = f"WITH {SIM} SELECT a.doc_id AS a, b.doc_id AS b, {APART} AS distance FROM sim a JOIN sim b ON a.doc_id % 50 = 0 AND b.doc_id <> a.doc_id"
# the fiftieth that asks is held by every task: no side of the product is kept on disk
add("q_hamming", HAMMING, HAMMING.replace("SELECT a.doc_id AS a", "SELECT /*+ BROADCAST(a) */ a.doc_id AS a"))
BANDS = "band AS (SELECT doc_id, high, low, k, CASE k WHEN 0 THEN floor(high / 65536e0) WHEN 1 THEN high % 65536 WHEN 2 THEN floor(low / 65536e0) ELSE low % 65536 END AS part FROM (SELECT doc_id, high, low, @each(@range(0 | 3)) AS k FROM sim) q)"
add("q_near_duplicates", f"WITH {SIM}, {BANDS} SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, {APART} AS distance FROM band a JOIN band b ON a.k = b.k AND a.part = b.part AND a.doc_id < b.doc_id WHERE {APART} <= 3")
# --- strings ---------------------------------------------------------------------------------------------------------------
add("q_clean_text", "SELECT doc_id, trim(@rr(@rr(text | '[ \\t]+' | ' ') | '\\n{3,}' | '\n\n')) AS text FROM documents")
add("q_normalize_letters", "SELECT doc_id, trim(@rr(lower(text) | '[^\\p{L}]+' | ' ')) AS text FROM documents")
add("q_index_terms", "SELECT doc_id, term, count(*) AS tf FROM @tokens x WHERE length(term) BETWEEN 2 AND 40 AND term NOT IN ('the', 'of', 'and', 'to', 'in', 'de', 'la', 'der', 'die', 'le', 'el', 'que') GROUP BY doc_id, term")
add("q_normalise_segment", "SELECT conv_id, turn, trim(@rr(lower(text) | '[^\\p{L}\\p{N}]+' | ' ')) AS norm FROM conversations")
add("q_normalize_heading", "WITH t AS (SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title FROM pages), s AS (SELECT page_id, title, @size(@all(title | '\\p{Lu}[^ ]*' | 0)) AS caps, @size(@all(title | '[^ ]+' | 0)) AS words FROM t) SELECT page_id, CASE WHEN words > 0 AND caps >= 0.6e0 * words THEN concat(substring(title, 1, 1), lower(substring(title, 2))) ELSE title END AS title FROM s")
add("q_dehyphenate", "SELECT doc_id, replace(text, '-\n', '') AS text FROM documents WHERE text LIKE '%-%'")
add("q_headings", "WITH l AS (SELECT doc_id, @each(@all(text | '[^\\n]+' | 0)) AS line FROM documents) SELECT doc_id, count(*) AS headings FROM l WHERE length(line) < 80 AND NOT @like(line | '[.,;:!?]$') AND @like(line | '^\\p{Lu}') GROUP BY doc_id")
add("q_strip_markdown", "SELECT conv_id, turn, @rr(@rr(text | '[*_`#>]+' | '') | '\\[([^\\]]*)\\]\\([^)]*\\)' | '') AS text FROM conversations")
add("q_utterance_normalize", "SELECT conv_id, turn, trim(@rr(@rr(@rr(lower(text) | '[!?;:,]+' | ' ') | '(^| )(please|uh|um|well|so)( |$)' | ' ') | ' +' | ' ')) AS utterance FROM conversations")
add("q_detokenise", "WITH t AS (SELECT conv_id, turn, @each(@all(text | '\\p{L}+|[.,!?]' | 0)) AS w FROM conversations) SELECT conv_id, turn, count(*) AS pieces, count(CASE WHEN @like(w | '^[.,!?]$') THEN 1 END) AS marks FROM t GROUP BY conv_id, turn")
add("q_parse_grade", "SELECT event_id, CASE WHEN @json(props | '$.k') IS NULL THEN NULL ELSE @long(@json(props | '$.k')) % 4 END AS grade FROM events")
add("q_parse_date", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS DATE) AS d, extract(year FROM o_orderdate) AS y FROM orders")
add("q_spoken_numbers", "SELECT doc_id, @size(@all(text | '[0-9]+' | 0)) AS numbers, @size(@all(text | '[0-9]+%' | 0)) AS percents FROM documents")
add("q_acronyms", "WITH a AS (SELECT doc_id, @each(@all(text | '\\p{Lu}{2,6}' | 0)) AS a FROM documents) SELECT a, count(*) AS n, @like(a | '[AEIOUY]') AS pronounceable FROM a GROUP BY a")
add("q_scs_identifier", "SELECT source, lang, @rr(lower(concat(source, ' ', lang)) | '[^a-z0-9]+' | '_') AS identifier, count(*) AS n FROM documents GROUP BY source, lang")
add("q_pitch_factor", "SELECT st, round(pow(2e0, st / 12e0), 6) AS factor, round(least(2e0, greatest(0.5e0, pow(2e0, st / 12e0))), 6) AS clamped FROM (SELECT @each(@range(-24 | 24)) AS st)")
add("q_pitch_timings", "SELECT event_id, round(value / pow(2e0, (event_id % 13 - 6) / 12e0), 6) AS seconds FROM events")
add("q_clip_text", "SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE concat(@rr(substring(text, 1, 200) | ' [^ ]*$' | ''), '...') END AS clip FROM documents")
add("q_homoglyph", "SELECT doc_id, translate(text, 'aceopxyABCEHKMOPTX', 'асеорхуАВСЕНКМОРТХ') AS swapped FROM documents")


def _word_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth document with all others that share a term."""
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)), lambda w: F.length(w) >= 2))
    docs = merged(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(F.col("doc_id").alias("id"), F.lit(0).alias("more"), words.alias("words"))
    sets = docs.select("id", "more", F.size("words").alias("size"), "words", F.lit(None).alias("weights"))
    return pairs.ratios(sets.where("id % 50 = 0"), sets, jaccard=True)


MADE["like_word_sets"] = _word_sets
add("q_jaccard", f"WITH {TF}, s AS (SELECT doc_id, count(*) AS n FROM tf GROUP BY doc_id) SELECT a.doc_id AS a, b.doc_id AS b, round(count(*) / CAST(max(x.n) + max(y.n) - count(*) AS DOUBLE), 6) AS jaccard FROM tf a JOIN tf b ON a.term = b.term AND a.doc_id % 50 = 0 AND b.doc_id <> a.doc_id JOIN s x ON x.doc_id = a.doc_id JOIN s y ON y.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id", "SELECT a, b, round(value, 6) AS jaccard FROM like_word_sets")
add("q_cache_evict", "WITH e AS (SELECT event_id, value, ts, @long(floor(@second(ts) / 3600e0)) AS hour FROM events), h AS (SELECT hour, sum(sum(value)) OVER (ORDER BY hour DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - sum(value) AS newer FROM e GROUP BY hour) SELECT event_id, total > 20000 AS evicted FROM (SELECT e.event_id, h.newer + sum(e.value) OVER (PARTITION BY e.hour ORDER BY e.ts DESC, e.event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM e JOIN h ON h.hour = e.hour)")
add("q_position_clamp", "SELECT event_id, greatest(0, least(@long(event_id * 3 - 100), 20000)) AS position FROM events")
# --- languages -------------------------------------------------------------------------------------------------------------
GRAMS = "wc AS (SELECT doc_id, lang, concat('_', term, '_') AS w, count(*) AS c FROM (SELECT doc_id, lang, @each(@words(text)) AS term FROM documents) t WHERE length(term) >= 2 GROUP BY doc_id, lang, concat('_', term, '_')), pc AS (SELECT doc_id, lang, w, c, @each(@range(1 | length(w))) AS p FROM wc), kc AS (SELECT doc_id, lang, w, c, p, @each(@range(1 | least(5, length(w) - p + 1))) AS k FROM pc), gram AS (SELECT doc_id, lang, substring(w, @int(p), @int(k)) AS gram, @long(sum(c)) AS c FROM kc GROUP BY doc_id, lang, substring(w, @int(p), @int(k)))"
# profiles need the words of a language once, however many documents have them; only the documents that are told need grams of their own
PROFILES = (
    "lw AS (SELECT lang, w, sum(c) AS c FROM wc WHERE doc_id % 2 = 0 GROUP BY lang, w), lp1 AS (SELECT lang, w, c, @each(@range(1 | length(w))) AS p FROM lw), lk AS (SELECT lang, w, c, p, @each(@range(1 | least(5, length(w) - p + 1))) AS k FROM lp1), "
    "lg AS (SELECT lang, substring(w, @int(p), @int(k)) AS gram, @long(sum(c)) AS c FROM lk GROUP BY lang, substring(w, @int(p), @int(k))), "
    "prof AS (SELECT lang, gram, i - 1 AS r FROM (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY c DESC, gram) AS i FROM lg) WHERE i <= 300), "
    "own AS (SELECT doc_id, lang, gram, i - 1 AS r FROM (SELECT doc_id, lang, gram, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, gram) AS i FROM gram WHERE doc_id % 2 = 1) WHERE i <= 300)"
)
DIST = "dist AS (SELECT o.doc_id, o.lang, l.lang AS guess, @long(sum(coalesce(abs(o.r - p.r), 300))) AS d, count(*) AS n FROM own o CROSS JOIN (SELECT DISTINCT lang FROM prof) l LEFT JOIN prof p ON p.lang = l.lang AND p.gram = o.gram GROUP BY o.doc_id, o.lang, l.lang), best AS (SELECT doc_id, lang, guess, d, n, lead(d) OVER (PARTITION BY doc_id ORDER BY d, guess) AS second, row_number() OVER (PARTITION BY doc_id ORDER BY d, guess) AS i FROM dist)"
LANGS = f"{GRAMS}, {PROFILES}, {DIST}"
# the queries count the words of a language before they cut them, and the grams of a document where it is read
MADE["top_grams"] = lambda spark, sf_dir: languages.top_grams(spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 2 = 1"))
CUT = "{0}p AS (SELECT lang, w, c, @each(@range(1 | length(w))) AS p FROM {0}), {0}k AS (SELECT lang, w, c, p, @each(@range(1 | least(5, length(w) - p + 1))) AS k FROM {0}p), {0}g AS (SELECT lang, substring(w, @int(p), @int(k)) AS gram, @long(sum(c)) AS c FROM {0}k GROUP BY lang, substring(w, @int(p), @int(k)))"
WORDS_OF = "SELECT lang, concat('_', term, '_') AS w, count(*) AS c FROM (SELECT lang, @each(@words(text)) AS term FROM documents{0}) t WHERE length(term) >= 2 GROUP BY lang, concat('_', term, '_')"
PROFILED = f"lw AS ({WORDS_OF.format(' WHERE doc_id % 2 = 0')}), {CUT.format('lw')}, prof AS (SELECT lang, gram, i - 1 AS r FROM (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY c DESC, gram) AS i FROM lwg) WHERE i <= 300)"
OWN_LANGS = f"{PROFILED}, own AS (SELECT doc_id, lang, gram, r FROM top_grams), {DIST.replace('SELECT o.doc_id', 'SELECT /*+ BROADCAST(l), BROADCAST(p) */ o.doc_id')}"


def add_lang(name: str, template: str) -> None:
    """A query over LANGS, by OWN_LANGS."""
    add(name, template, template.replace(LANGS, OWN_LANGS))


add("q_ngrams", f"WITH {GRAMS} SELECT lang, gram, @long(sum(c)) AS n FROM gram GROUP BY lang, gram", f"WITH aw AS ({WORDS_OF.format('')}), {CUT.format('aw')} SELECT lang, gram, c AS n FROM awg")
add("q_lang_profiles", f"WITH {GRAMS}, {PROFILES} SELECT lang, gram, r FROM prof", f"WITH {PROFILED} SELECT lang, gram, r FROM prof")
add_lang("q_out_of_place", f"WITH {LANGS} SELECT doc_id, guess, d FROM dist")
add_lang("q_lang_ngram", f"WITH {LANGS} SELECT doc_id, lang, guess, round(least(1e0, 3e0 * (second - d) / (n * 300e0)), 4) AS confidence FROM best WHERE i = 1")
ALPHA = "ch AS (SELECT doc_id, lang, @each(@all(lower(text) | '\\p{L}' | 0)) AS c FROM documents), cc AS (SELECT doc_id, lang, c, count(*) AS n FROM ch GROUP BY doc_id, lang, c), lp AS (SELECT lang, c, CAST(sum(n) AS DOUBLE) AS n FROM cc WHERE doc_id % 2 = 0 GROUP BY lang, c), ln2 AS (SELECT lang, sqrt(sum(n * n)) AS norm FROM lp GROUP BY lang), dn AS (SELECT doc_id, sqrt(sum(CAST(n AS DOUBLE) * n)) AS norm FROM cc GROUP BY doc_id), al AS (SELECT x.doc_id, x.lang, lp.lang AS guess, sum(x.n * lp.n) / (max(dn.norm) * max(ln2.norm)) AS cosine FROM cc x JOIN lp ON lp.c = x.c JOIN ln2 ON ln2.lang = lp.lang JOIN dn ON dn.doc_id = x.doc_id WHERE x.doc_id % 2 = 1 GROUP BY x.doc_id, x.lang, lp.lang)"
add("q_lang_alphabet", f"WITH {ALPHA} SELECT doc_id, guess, round(cosine, 4) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(cosine, 9) DESC, guess) AS i FROM al) WHERE i = 1")
# eight stretches of each length from a hashed start, or the whole text where it is shorter
CURVE = ALPHA + ", nl AS (SELECT doc_id, lang, trim(@rr(lower(text) | '[^\\p{L}]+' | ' ')) AS t FROM documents WHERE doc_id % 2 = 1), cut AS (SELECT doc_id, lang, t, size, @each(@range(1 | 8)) AS k FROM (SELECT doc_id, lang, t, 20 * @int(pow(2, e)) AS size FROM (SELECT doc_id, lang, t, @each(@range(0 | 4)) AS e FROM nl WHERE length(t) >= 5) q) r), fr AS (SELECT doc_id, lang, size, k, substring(t, @int(1 + @hash(concat(@text(doc_id), ':', @text(size), ':', @text(k))) % greatest(1, length(t) - size + 1)), @int(size)) AS f FROM cut), fc AS (SELECT doc_id, lang, size, k, c, count(*) AS n FROM (SELECT doc_id, lang, size, k, @each(@all(f | '\\p{L}' | 0)) AS c FROM fr) q GROUP BY doc_id, lang, size, k, c), fg AS (SELECT f.doc_id, f.lang, f.size, f.k, lp.lang AS guess, sum(f.n * lp.n) / max(ln2.norm) AS cosine FROM fc f JOIN lp ON lp.c = f.c JOIN ln2 ON ln2.lang = lp.lang GROUP BY f.doc_id, f.lang, f.size, f.k, lp.lang), fb AS (SELECT *, row_number() OVER (PARTITION BY doc_id, size, k ORDER BY round(cosine, 6) DESC, guess) AS i FROM fg), lc AS (SELECT size, count(*) AS total, count(CASE WHEN guess = lang THEN 1 END) / CAST(count(*) AS DOUBLE) AS accuracy FROM fb WHERE i = 1 GROUP BY size)"
add("q_learning_curve", f"WITH {CURVE} SELECT size, total, round(accuracy, 4) AS accuracy FROM lc")
add("q_learning_least", f"WITH {CURVE} SELECT min(CASE WHEN accuracy >= 0.95 THEN size END) AS least, count(*) AS lengths FROM lc")
VOTE = "v AS (SELECT doc_id, lang, guess, 'ngram' AS m FROM best WHERE i = 1 UNION ALL SELECT doc_id, lang, guess, 'alphabet' FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(cosine, 9) DESC, guess) AS i FROM al) WHERE i = 1)"
add_lang("q_lang_vote", f"WITH {LANGS}, {ALPHA}, {VOTE} SELECT doc_id, max(lang) AS lang, min(guess) AS guess, count(DISTINCT guess) = 1 AS agree FROM v GROUP BY doc_id")
add_lang("q_lang_confusion", f"WITH {LANGS}, {ALPHA}, {VOTE} SELECT m, lang, guess, count(*) AS n FROM v GROUP BY m, lang, guess")
add_lang("q_lang_accuracy", f"WITH {LANGS}, {ALPHA}, {VOTE} SELECT m, count(*) AS n, round(count(CASE WHEN lang = guess THEN 1 END) / CAST(count(*) AS DOUBLE), 6) AS accuracy FROM v GROUP BY m")
add_lang("q_lang_report", f"WITH {LANGS} SELECT concat_ws(';', @text(doc_id), lang, guess, @text(d)) AS line FROM best WHERE i = 1")
add("q_corpus_stats", "SELECT lang, count(*) AS documents, @long(sum(length(text))) AS chars FROM documents GROUP BY lang")
add("q_script_language", "SELECT doc_id, CASE WHEN length(@rr(text | '[^а-яёА-ЯЁ]' | '')) >= length(@rr(text | '[^a-zA-Z]' | '')) THEN 'ru' ELSE 'en' END AS lang FROM documents")
# --- summaries -------------------------------------------------------------------------------------------------------------
add("q_paragraphs", "WITH p AS (SELECT doc_id, @each(@all(text | '[^\\n]+' | 0)) AS p FROM documents) SELECT doc_id, count(*) AS paragraphs, @long(sum(length(p))) AS chars FROM p GROUP BY doc_id")
add("q_summary_tokens", "SELECT doc_id, pos, term FROM @tokens x WHERE length(term) >= 3 AND term NOT IN ('the', 'and', 'that', 'for', 'with', 'les', 'des', 'der', 'die', 'und', 'que', 'los')")
add("q_filter_report", "SELECT doc_id, @size(@all(text | '[^ \\n]+' | 0)) AS words, @size(@all(text | '[0-9]+' | 0)) AS numbers, @size(@all(text | '\\p{L}+' | 0)) AS letters FROM documents")
MAX = "mx AS (SELECT doc_id, max(tf) AS tf_max FROM tf GROUP BY doc_id)"
AUG = "aug AS (SELECT tf.doc_id, tf.term, tf.tf, tf.first_pos, 0.5e0 * (1 + tf.tf / CAST(mx.tf_max AS DOUBLE)) * idf.idf AS w FROM tf JOIN mx ON mx.doc_id = tf.doc_id JOIN idf ON idf.term = tf.term)"
add("q_tf_max", f"WITH {TF}, {MAX} SELECT doc_id, tf_max FROM mx")
add("q_augmented_tfidf", f"WITH {TF}, {DF}, {N}, {IDF}, {MAX}, {AUG} SELECT doc_id, term, round(w, 6) AS w FROM aug")
add("q_summary_keywords", f"WITH {TF}, {DF}, {N}, {IDF}, {MAX}, {AUG} SELECT doc_id, term, k FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(w, 9) DESC, tf DESC, term) AS k FROM aug) WHERE k <= 15")
add("q_frequent_form", "WITH f AS (SELECT lower(s) AS term, s, count(*) AS n FROM (SELECT @each(@all(text | '\\p{L}+' | 0)) AS s FROM documents) GROUP BY lower(s), s) SELECT term, s AS form, n FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY n DESC, s) AS i FROM f) WHERE i = 1")
add("q_df_histogram", f"WITH {TF}, {DF}, h AS (SELECT df, count(*) AS terms FROM df GROUP BY df), {N}, b AS (SELECT @each(@range(1 | n)) AS df FROM n) SELECT b.df, coalesce(h.terms, 0) AS terms, round(ln(n.n / CAST(b.df AS DOUBLE)), 6) AS idf FROM b CROSS JOIN n LEFT JOIN h ON h.df = b.df")
add("q_zipf", f"WITH {TF}, {DF}, r AS (SELECT cf, row_number() OVER (ORDER BY cf DESC, term) AS r FROM df) SELECT round(-regr_slope(ln(cf), ln(r)), 6) AS slope, count(*) AS points, (SELECT count(*) FROM df WHERE cf = 1) AS hapax FROM r WHERE cf >= 2")
add("q_collection_statistics", f"WITH {TF}, s AS (SELECT doc_id, @long(sum(tf)) AS words, count(*) AS terms FROM tf GROUP BY doc_id) SELECT count(*) AS documents, @long(sum(words)) AS words, round(avg(terms), 6) AS terms FROM s")
# sentences with their places: of the start in the document, and in the paragraph with its length
LINES = (
    "pc AS (SELECT doc_id, p, j, piece FROM @pieces q), pl AS (SELECT doc_id, p, sum(length(piece)) AS plen FROM pc GROUP BY doc_id, p), pp AS (SELECT doc_id, p, plen, coalesce(sum(plen) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + p AS pstart, sum(plen) OVER (PARTITION BY doc_id) + max(p) OVER (PARTITION BY doc_id) AS whole FROM pl), "
    "pj AS (SELECT pc.doc_id, pc.p, pc.j, pc.piece, coalesce(sum(length(pc.piece)) OVER (PARTITION BY pc.doc_id, pc.p ORDER BY pc.j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inside FROM pc), "
    "ls1 AS (SELECT pj.doc_id, @long(row_number() OVER (PARTITION BY pj.doc_id ORDER BY pj.p, pj.j) - 1) AS i, pj.piece AS s, pp.pstart + pj.inside AS start, pp.whole, pj.inside, pp.plen FROM pj JOIN pp ON pp.doc_id = pj.doc_id AND pp.p = pj.p WHERE @like(pj.piece | '\\p{L}')), "
    "ln0 AS (SELECT doc_id, i, s FROM ls1), st AS (SELECT doc_id, i, term, count(*) AS tfs FROM (SELECT doc_id, i, @each(@words(s)) AS term FROM ln0) x WHERE length(term) >= 2 GROUP BY doc_id, i, term)"
)
# the score of a sentence is the sum of tf * w over its terms; its weight is that by its places in document and paragraph
SCORED = f"{TF}, {DF}, {N}, {IDF}, {MAX}, {AUG}, {LINES}, sc AS (SELECT st.doc_id, st.i, sum(st.tfs * aug.w) AS score, sum(st.tfs) AS terms FROM st JOIN aug ON aug.doc_id = st.doc_id AND aug.term = st.term GROUP BY st.doc_id, st.i), sw AS (SELECT l.doc_id, l.i, l.s, l.posd * l.posp * coalesce(sc.score, 0) AS w, coalesce(sc.score, 0) AS score, sc.terms, l.posd, l.posp FROM (SELECT *, 1 - start / CAST(whole AS DOUBLE) AS posd, 1 - inside / CAST(plen AS DOUBLE) AS posp FROM ls1) l LEFT JOIN sc ON sc.doc_id = l.doc_id AND sc.i = l.i)"
# the queries work sentences out a document at a time
MADE["scored_sentences"] = lambda spark, sf_dir: summaries.scores(Index.of(spark, sf_dir), spark.read.parquet(f"{sf_dir}/documents.parquet"))
MADE["selected_sentences"] = lambda spark, sf_dir: summaries.selected(Index.of(spark, sf_dir), spark.read.parquet(f"{sf_dir}/documents.parquet"))
MADE["summary_measures"] = lambda spark, sf_dir: summaries.measures(Index.of(spark, sf_dir), spark.read.parquet(f"{sf_dir}/documents.parquet"))
MADE["sentence_terms"] = lambda spark, sf_dir: summaries.contributions(Index.of(spark, sf_dir), spark.read.parquet(f"{sf_dir}/documents.parquet"))
MADE["like_sentences"] = lambda spark, sf_dir: summaries.edges(Index.of(spark, sf_dir), spark.read.parquet(f"{sf_dir}/documents.parquet"), 0.03)


SELECTED = "sel AS (SELECT doc_id, i, s, w FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(w, 9) DESC, i) AS k FROM sw) WHERE k <= 5)"


def add_scored(name: str, template: str) -> None:
    """A query over SCORED, by scored_sentences; by selected_sentences where only the sentences of summaries count."""
    few = f"{SCORED}, {SELECTED}"
    add(name, template, template.replace(few, f"sw AS (SELECT * FROM selected_sentences), {SELECTED}") if few in template else template.replace(SCORED, "sw AS (SELECT * FROM scored_sentences)"))


add_scored("q_sentence_scores", f"WITH {SCORED} SELECT doc_id, i, round(w, 6) AS w, round(w / sqrt(coalesce(terms, 1)), 6) AS w_sqrt, round(w / coalesce(terms, 1), 6) AS w_linear, round(score * posd * sqrt(posp), 6) AS w_alpha_1_beta_half FROM sw")
add_scored("q_summary_select", f"WITH {SCORED}, {SELECTED} SELECT doc_id, i FROM sel")
add_scored("q_summary_text", f"WITH {SCORED}, {SELECTED} SELECT doc_id, @join(trim(s) | ' ' | i) AS summary FROM sel GROUP BY doc_id")
add_scored("q_summaries", f"WITH {SCORED}, {SELECTED} SELECT doc_id, count(*) AS sentences, @long(sum(length(s))) AS chars FROM sel GROUP BY doc_id")
add("q_lead", f"WITH {LINES} SELECT doc_id, i, s FROM ln0 WHERE i < 3")
add("q_sentence_contributions", f"WITH {TF}, {DF}, {N}, {IDF}, {MAX}, {AUG}, {LINES} SELECT doc_id, i, term, round(w, 6) AS w FROM (SELECT st.doc_id, st.i, st.term, st.tfs * aug.w AS w, row_number() OVER (PARTITION BY st.doc_id, st.i ORDER BY round(st.tfs * aug.w, 9) DESC, st.term) AS k FROM st JOIN aug ON aug.doc_id = st.doc_id AND aug.term = st.term) WHERE k <= 6", "SELECT doc_id, i, term, round(w, 6) AS w FROM sentence_terms")
add("q_sentence_edges", f"WITH {TF}, {DF}, {N}, {IDF}, {MAX}, {AUG}, {LINES}, sv AS (SELECT st.doc_id, st.i, st.term, st.tfs * aug.w AS v FROM st JOIN aug ON aug.doc_id = st.doc_id AND aug.term = st.term WHERE aug.w > 0), z AS (SELECT doc_id, i, sqrt(sum(v * v)) AS norm FROM sv GROUP BY doc_id, i), e AS (SELECT a.doc_id, a.i AS a, b.i AS b, sum(a.v * b.v) / (max(x.norm) * max(y.norm)) AS sim FROM sv a JOIN sv b ON a.doc_id = b.doc_id AND a.term = b.term AND a.i < b.i JOIN z x ON x.doc_id = a.doc_id AND x.i = a.i JOIN z y ON y.doc_id = b.doc_id AND y.i = b.i GROUP BY a.doc_id, a.i, b.i) SELECT doc_id, a, b, round(sim, 6) AS sim FROM e WHERE sim > 0.03", "SELECT doc_id, a, b, round(sim, 6) AS sim FROM like_sentences")
add("q_rouge_n", f"WITH {TF}, b AS (SELECT item_id, term, count(*) AS n FROM (SELECT item_id, @each(@words(text)) AS term FROM benchmark) q GROUP BY item_id, term), z AS (SELECT item_id, sum(n) AS n FROM b GROUP BY item_id) SELECT b.item_id, tf.doc_id, round(sum(least(b.n, tf.tf)) / CAST(max(z.n) AS DOUBLE), 6) AS recall FROM b JOIN tf ON tf.term = b.term JOIN z ON z.item_id = b.item_id GROUP BY b.item_id, tf.doc_id")
# keywords of the document that the summary's terms have; sentences of the largest scores that it keeps; where its sentences begin
QUALITY = (
    "kw AS (SELECT doc_id, term FROM (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY round(w, 9) DESC, tf DESC, term) AS k FROM aug) WHERE k <= 15), said AS (SELECT DISTINCT st.doc_id, st.term FROM st JOIN sel ON sel.doc_id = st.doc_id AND sel.i = st.i), "
    "cov AS (SELECT kw.doc_id, count(said.term) / CAST(count(*) AS DOUBLE) AS coverage FROM kw LEFT JOIN said ON said.doc_id = kw.doc_id AND said.term = kw.term GROUP BY kw.doc_id), "
    "top AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, i) AS k FROM sw) WHERE k <= 5), topn AS (SELECT doc_id, count(*) AS total FROM top GROUP BY doc_id)"
)
COMPRESSION = "round(CASE WHEN max(d.n_chars) > 0 THEN {0} / CAST(max(d.n_chars) AS DOUBLE) ELSE 0e0 END, 6) AS compression"
add(
    "q_summary_quality",
    f"WITH {SCORED}, {SELECTED}, {QUALITY} SELECT s.doc_id, {COMPRESSION.format('sum(length(s.s))')}, round(avg(CASE WHEN s.i = 0 THEN 1e0 ELSE 0e0 END), 6) AS lead_share, round(coalesce(max(cov.coverage), 0e0), 6) AS keyword_coverage, count(top.i) AS content_top_kept, max(topn.total) AS content_top_total, round(avg(l.start / CAST(l.whole AS DOUBLE)), 6) AS mean_position, count(CASE WHEN 3 * l.start > 2 * l.whole THEN 1 END) AS last_third "
    "FROM sel s JOIN documents d ON d.doc_id = s.doc_id JOIN ls1 l ON l.doc_id = s.doc_id AND l.i = s.i JOIN topn ON topn.doc_id = s.doc_id LEFT JOIN cov ON cov.doc_id = s.doc_id LEFT JOIN top ON top.doc_id = s.doc_id AND top.i = s.i GROUP BY s.doc_id",
    f"SELECT s.doc_id, {COMPRESSION.format('max(s.chars)')}, round(max(s.lead), 6) AS lead_share, round(max(s.coverage), 6) AS keyword_coverage, max(s.top_kept) AS content_top_kept, max(s.top_total) AS content_top_total, round(max(s.position), 6) AS mean_position, max(s.last_third) AS last_third FROM summary_measures s JOIN documents d ON d.doc_id = s.doc_id GROUP BY s.doc_id",
)
add_scored("q_batch_report", f"WITH {SCORED}, {SELECTED} SELECT d.lang, count(DISTINCT s.doc_id) AS documents, count(*) AS sentences FROM sel s JOIN documents d ON d.doc_id = s.doc_id GROUP BY d.lang")
add_scored("q_sentence_csv", f"WITH {SCORED} SELECT concat_ws(';', @text(doc_id), @text(i), @text(@long(round(w, 0)))) AS line FROM sw")
KEY = "kw AS (SELECT doc_id, term, w FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(w, 9) DESC, term) AS k FROM aug) WHERE k <= 30), kn AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM kw GROUP BY doc_id)"


def _like_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents by their thirty heaviest terms."""
    index = Index.of(spark, sf_dir)
    rows = index.forward().select("doc_id", "term", "tf").join(index.table("terms").select("term", "idf"), "term")
    own = Window.partitionBy("doc_id")
    rows = rows.withColumn("w", 0.5 * (1 + F.col("tf") / F.max("tf").over(own)) * F.col("idf"))
    kept = rows.withColumn("k", F.row_number().over(own.orderBy(F.desc(F.round("w", 9)), "term"))).where("k <= 30")
    by = kept.groupBy(F.col("doc_id").alias("id")).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"), F.collect_list(F.struct("term", "w")).alias("own")).where("size > 0")
    return pairs.ratios(by.select("id", F.lit(0).alias("more"), "size", F.col("own.term").alias("words"), F.col("own.w").alias("weights")), least=0.08)


MADE["like_documents"] = _like_documents
add("q_doc_similarity", f"WITH {TF}, {DF}, {N}, {IDF}, {MAX}, {AUG}, {KEY}, p AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(a.w * b.w) / (max(x.norm) * max(y.norm)) AS sim FROM kw a JOIN kw b ON a.term = b.term AND a.doc_id < b.doc_id JOIN kn x ON x.doc_id = a.doc_id JOIN kn y ON y.doc_id = b.doc_id WHERE x.norm > 0 AND y.norm > 0 GROUP BY a.doc_id, b.doc_id) SELECT a, b, round(sim, 6) AS sim FROM p WHERE sim >= 0.08", "SELECT a, b, round(value, 6) AS sim FROM like_documents")
add("q_graph_edges", f"WITH {TF}, {DF}, {N}, {IDF}, {MAX}, {AUG}, {KEY} SELECT concat('doc_', @text(doc_id)) AS source, concat('term_', term) AS target, round(w, 6) AS weight FROM kw")
add("q_collection_add", "SELECT doc_id, concat(source, '-', @text(row_number() OVER (PARTITION BY source ORDER BY doc_id))) AS name FROM documents WHERE length(text) >= 400")
