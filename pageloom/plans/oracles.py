"""The registered queries in SQL (DuckDB), to compare results with.

Nothing here is shared with the operators except the fixed values and the SQL
text that derives the inputs.
"""

from __future__ import annotations

from pageloom import config
from pageloom.plans import tables as t

ORACLES: dict[str, str] = {}

NL = "chr(10)"
WHITE = " || ".join(
    f"chr({code})"
    for code in (
        *range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288,
    )
)


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(text: str) -> str:
    return f"trim({text}, {WHITE})"


def replace_all(text: str, pattern: str, kept: str = "''", flags: str = "g") -> str:
    return f"regexp_replace({text}, {q(pattern)}, {kept}, '{flags}')"


def with_(ctes: list[tuple[str, str]], final: str) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in ctes) + "\n" + final


# ----------------------------------------------------------------------- paths

PATHS = (
    "paths",
    f"SELECT unnest([{', '.join(t.PATH_FORMS_SQL)}]) AS path FROM documents UNION ALL SELECT url FROM pages",
)
SUFFIX = r"(\.html|\.md)$"


def _tail(path: str, start: str) -> str:
    return f"substr({path}, {start})"


def url_from_base(path: str) -> str:
    below = _tail(path, str(len(t.BASE) + 1))
    after = f"substr({below}, strpos({below}, '/') + 1)"
    domain = f"split_part({after}, '/', 1)"
    rest = f"substr({after}, length({domain}) + 2)"
    return (
        f"CASE WHEN starts_with({path}, '{t.BASE}') AND strpos({below}, '/') > 0 "
        f"THEN 'https://' || {domain} || '/' || {replace_all(rest, SUFFIX)} ELSE {path} END"
    )


def url_from_docs(path: str) -> str:
    pattern = q("/docs/[^/]+/([^/]+)/(.*)$")
    domain = f"regexp_extract({path}, {pattern}, 1)"
    rest = replace_all(f"regexp_extract({path}, {pattern}, 2)", SUFFIX)
    return f"CASE WHEN {domain} <> '' THEN 'https://' || {domain} || '/' || {rest} ELSE {path} END"


def category_of(path: str) -> str:
    tests = " ".join(
        f"WHEN list_contains(string_split(lower({path}), '/'), '{lang}') THEN '{lang}'" for lang in t.LANGS
    )
    return f"CASE {tests} ELSE 'unknown' END"


def domain_of(path: str) -> str:
    below = _tail(path, f"strpos({path}, '{t.BASE}') + {len(t.BASE)}")
    return f"CASE WHEN strpos({path}, '{t.BASE}') > 0 THEN split_part({below}, '/', 2) ELSE '' END"


def allowed(path: str) -> str:
    domain = domain_of(path)
    tests = " OR ".join(
        f"ends_with({domain}, '{entry.removeprefix('*')}')" for entry in t.BLOCKED
    )
    return f"({domain} = '' OR NOT ({tests}))"


def name_of(path: str) -> str:
    return f"list_last(string_split({path}, '/'))"


def skipped(path: str) -> str:
    names = " OR ".join(
        f"contains(lower({name_of(path)}), '{part}')" for part in config.SKIP_NAME_PARTS
    )
    wholes = " OR ".join(f"contains(lower({path}), '{part}')" for part in config.SKIP_PATH_PARTS)
    return f"({names} OR {wholes})"


def scanned(path: str) -> str:
    name = f"lower({name_of(path)})"
    ends = " OR ".join(f"ends_with({name}, '{suffix}')" for suffix in config.SCANNED_SUFFIXES)
    return f"(({ends} OR NOT contains({name}, '.')) AND NOT {skipped(path)} AND {allowed(path)})"


for _name, _value in {
    "path_to_url": url_from_base("path"),
    "url_regex_variant": url_from_docs("path"),
    "detect_category": category_of("path"),
    "extract_domain": domain_of("path"),
    "allowed_domain": allowed("path"),
    "skip_file": skipped("path"),
}.items():
    ORACLES[_name] = with_([PATHS], f"SELECT path, {_value} AS {_name} FROM paths")

ORACLES["scan_filter"] = with_([PATHS], f"SELECT path FROM paths WHERE {scanned('path')}")
ORACLES["candidate_count"] = with_(
    [PATHS], f"SELECT count(*) AS candidate_files FROM paths WHERE {scanned('path')}"
)

DOCS = (
    "docs",
    f"SELECT doc_id AS id, {t.PATH_SQL} AS path, {t.URL_SQL} AS url, text, lang AS category FROM documents",
)
VECS = ("vecs", "SELECT vec_id AS doc_id, embedding FROM embeddings")
_ADDRESS = "^[a-z][a-z0-9+.-]*://([^/?#]*)([^?#]*)"
WEB = (
    "web",
    f"""SELECT '{t.BASE}' || split_part(regexp_extract(url, '{_ADDRESS}', 2), '/', 2) || '/'
 || regexp_extract(url, '{_ADDRESS}', 1) || regexp_extract(url, '{_ADDRESS}', 2) AS path,
 html AS raw, page_id AS seq FROM pages""",
)

ORACLES["effective_url"] = with_(
    [DOCS],
    f"SELECT id, CASE WHEN url IS NULL OR url = '' THEN {url_from_docs('path')} ELSE url END AS effective_url FROM docs",
)
ORACLES["source_by_category"] = with_(
    [WEB], f"SELECT seq, path FROM web WHERE starts_with(path, '{t.BASE}fr/')"
)
ORACLES["source_by_prefix"] = ORACLES["source_by_category"]
ORACLES["category_documents"] = with_([DOCS], "SELECT id, path, text FROM docs WHERE category = 'fr'")

# ------------------------------------------------------------------ extraction

NOISY = ("noisy", f"SELECT doc_id, {t.NOISY_SQL} AS text FROM documents")

ORACLES["decode_text"] = with_(
    [NOISY],
    f"""SELECT doc_id, replace(replace(text, chr(13) || {NL}, {NL}), chr(13), {NL})
 || {NL} || 'end' || {NL} || 'end' AS text FROM noisy""",
)

ORACLES["doc_kind"] = with_(
    [
        WEB,
        (
            "everything",
            """SELECT seq, path, raw FROM web
 UNION ALL SELECT seq, 'page' || seq, raw FROM web
 UNION ALL SELECT seq, 'plain' || seq, regexp_replace(raw, '(?i)<(html|!doctype)', '<x', 'g') FROM web
 UNION ALL SELECT seq, path || '.MD', raw FROM web""",
        ),
        (
            "sniffed",
            f"""SELECT *, contains(lower(substr(raw, 1, {config.SNIFF_CHARS})), '<html')
 OR contains(lower(substr(raw, 1, {config.SNIFF_CHARS})), '<!doctype') AS looks_like_html FROM everything""",
        ),
    ],
    "SELECT seq, path, looks_like_html, "
    + ", ".join(
        f"""CASE WHEN lower(path) LIKE '%.md' THEN 'markdown'
 WHEN lower(path) LIKE '%.html' OR lower(path) LIKE '%.htm' THEN 'html'
 WHEN NOT contains({tested}, '.') AND looks_like_html THEN 'html' ELSE 'none' END AS {name}"""
        for tested, name in (("path", "kind"), (name_of("path"), "kind_by_name"))
    )
    + " FROM sniffed",
)


def _one_line_end(text: str) -> str:
    return f"replace(replace({text}, chr(13) || {NL}, {NL}), chr(13), {NL})"


_BLOCKS = """p|div|h[1-6]|li|ul|ol|dl|dt|dd|section|article|main|header|aside|pre|blockquote
|figure|figcaption|address|details|summary|tr|td|th""".replace(chr(10), "")


def _is_tag(token: str, names: str) -> str:
    return f"regexp_matches({token}, '(?i)^<(?:{names})(?:[^0-9A-Za-z_-][^>]*)?>$')"


def html_ctes(source: str) -> list[tuple[str, str]]:
    """CTEs that replace ``raw`` in the rows of ``source`` by ``text`` (in ``html_text``).

    Tags and texts are rows; how many elements of a kind are open is a running sum.
    """
    bare = replace_all(replace_all("raw", "(?s)<!--.*?-->"), r"(?is)<(?:script|style)\b.*?</(?:script|style)\s*>")

    def open_elements(names: str, rows: str) -> str:
        step = f"CASE WHEN {_is_tag('tok', names)} THEN 1 WHEN {_is_tag('tok', f'/(?:{names})')} THEN -1 ELSE 0 END"
        return f"""SELECT *, sum(step) OVER (PARTITION BY rid ORDER BY pos) AS after, after - step AS before
 FROM (SELECT *, {step} AS step FROM {rows})"""

    body = r"regexp_extract(kept, '(?is)<body\b[^>]*>(.*?)</body>', 1)"
    text = f"""CASE WHEN {_is_tag('tok', f'/?(?:{_BLOCKS})|br|hr')} THEN {NL} WHEN starts_with(tok, '<') AND len(tok) > 1 THEN '' ELSE tok END"""
    # The marks around an outermost article give one line end between it and the next.
    inside = f"""CASE WHEN before = 0 THEN (CASE WHEN row_number() OVER (PARTITION BY rid, before = 0 ORDER BY pos) = 1 THEN '' ELSE {NL} END)
 WHEN after = 0 THEN '' ELSE {text} END"""
    decoded = "text"
    for entity, char in (("lt", "'<'"), ("gt", "'>'"), ("quot", "chr(34)"), ("#39", "chr(39)"), ("nbsp", "chr(160)"), ("amp", "'&'")):
        decoded = f"replace({decoded}, '&{entity};', {char})"
    return [
        ("html_rows", f"SELECT *, row_number() OVER () AS rid FROM {source}"),
        ("html_lists", f"SELECT rid, regexp_extract_all({bare}, '<[^>]*>|[^<]+|<') AS toks FROM html_rows"),
        ("html_tokens", "SELECT rid, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM html_lists"),
        ("html_outside", open_elements("nav|footer|table", "html_tokens")),
        ("html_kept", "SELECT rid, pos, tok FROM html_outside WHERE before = 0 AND after = 0"),
        ("html_articles", open_elements("article", "html_kept")),
        ("html_inside", f"SELECT rid, pos, {inside} AS piece FROM html_articles WHERE before > 0 OR after > 0"),
        ("html_main", "SELECT rid, string_agg(piece, '' ORDER BY pos) AS main FROM html_inside GROUP BY rid"),
        ("html_whole", "SELECT rid, string_agg(tok, '' ORDER BY pos) AS kept FROM html_kept GROUP BY rid"),
        ("html_bodies", f"SELECT rid, CASE WHEN {body} <> '' THEN {body} ELSE kept END AS kept FROM html_whole"),
        (
            "html_plain",
            f"""SELECT rid, string_agg({text}, '' ORDER BY pos) AS text
 FROM (SELECT rid, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos
  FROM (SELECT rid, regexp_extract_all(kept, '<[^>]*>|[^<]+|<') AS toks FROM html_bodies)) GROUP BY rid""",
        ),
        (
            "html_joined",
            f"""SELECT r.* EXCLUDE (raw, rid), {decoded.replace('text', "coalesce(nullif(m.main, ''), p.text, '')")} AS text
 FROM html_rows r LEFT JOIN html_main m USING (rid) LEFT JOIN html_plain p USING (rid)""",
        ),
        (
            "html_text",
            f"SELECT * REPLACE (CASE WHEN {strip('text')} = '' THEN '' ELSE text END AS text) FROM html_joined",
        ),
    ]


ORACLES["html_main_text"] = with_([WEB, *html_ctes("web")], "SELECT seq, text FROM html_text")
ORACLES["html_nested_text"] = with_(
    [WEB, ("nested", f"SELECT * REPLACE ({t.NESTED_SQL} AS raw) FROM web"), *html_ctes("nested")], "SELECT seq, text FROM html_text"
)

# What has to come of the part before the text is written out; the text has no code.
_before = """'Heading of ' || lang || ' quoted link &amp; code item one item two text a &lt; b &gt; c &amp;copy; py # *not* a `head` ``` still [code](x) '
 || 'quoted *code* &gt; x list - in *list* ``` deep_*code* more text still text after indented *code* '"""
_marked = "text"
for _pattern, _kept in (
    (r"(?m)^[ ]{0,3}\[[^\]\n]+\]:[ \t]*\S.*$", "''"),
    (r"!\[[^\]]*\]\([^)]*\)", "' '"),
    (r"\[([^\]]*)\]\([^)]*\)", r"'\1'"),
    (r"<(https?://[^>\s]+)>", r"'\1'"),
    (r"(?m)^#{1,6}[ \t]*", "''"),
    (r"(?m)^[ \t]*(?:[-*+]|\d+\.|>)[ \t]+", "''"),
    (r"\*\*|__", "''"),
    (r"\*([^*\s][^*\n]*)\*", r"'\1'"),
    (r"(?s)<!--.*?-->", "' '"),
    (r"</?[A-Za-z][^>]*>", "' '"),
    ("&", "'&amp;'"),
    (r"&amp;(#\d+;|#x[0-9A-Fa-f]+;|[A-Za-z][A-Za-z0-9]*;)", r"'&\1'"),
    ("<", "'&lt;'"),
    (">", "'&gt;'"),
    (r"\s+", "' '"),
):
    _marked = replace_all(_marked, _pattern, _kept)
ORACLES["markdown_text"] = f"SELECT doc_id, {strip(f'{_before} || {strip(_marked)}')} AS text FROM documents"

# -------------------------------------------------------------------- cleaning


def _remove(text: str, patterns) -> str:
    for pattern in patterns:
        text = replace_all(text, pattern, "''", "gi")
    return text


CSS = [pattern for pattern, _ in config.CSS_RULES]
NOISE = list(config.NOISE_PATTERNS)
LINES = "(?i)" + "|".join(f"(?:{pattern})" for pattern in config.LINE_NOISE_PATTERNS)


def keep_lines(text: str) -> str:
    kept = f"list_filter(string_split({text}, {NL}), lambda l: NOT regexp_matches({strip('l')}, {q(LINES)}))"
    return f"coalesce(array_to_string({kept}, {NL}), '')"


def people(text: str) -> str:
    # The end of a section is matched and put back, as there is no lookahead.
    for word in ("contributors?", "authors?", "maintainers?"):
        text = replace_all(text, rf"(?ims)^{word}:\s*$.*?(\n\s*\n|\n[A-Z]|\z)", r"'\1'")
    for word in ("written", "edited", "reviewed"):
        text = replace_all(text, rf"(?ims)^{word} by.*?(\n\s*\n|\n[A-Z]|\z)", r"'\1'")
    return text


UNREPEATED = (
    f"array_to_string(list_filter(ls, lambda l, i: i = 1 OR {strip('l')} = '' "
    f"OR {strip('l')} <> {strip('ls[i - 1]')}), {NL})"
)


def rejoin(text: str) -> str:
    return replace_all(text, r"([a-z])\n([a-z]{1,3})([^\p{L}\p{N}_]|$)", r"'\1\2\3'")


def blanks(text: str) -> str:
    return replace_all(text, r"[ \t]+", "' '")


def sentences(text: str) -> str:
    return replace_all(text, r"([.!?])\s+([A-Z])", rf"'\1' || {NL} || '\2'")


def blank_lines(text: str) -> str:
    return replace_all(text, r"\n\s*\n(\s*\n)+", f"{NL} || {NL}")


def line_ends(text: str) -> str:
    return replace_all(text, r"(?m)[ \t]+$")


def tidy(text: str) -> str:
    return strip(line_ends(blank_lines(sentences(blanks(rejoin(text))))))


def clean_ctes(source: str) -> list[tuple[str, str]]:
    """CTEs that clean ``text`` in the rows of ``source`` (in ``cleaned``)."""
    return [
        ("clean_a", f"SELECT * REPLACE ({_remove('text', CSS + NOISE)} AS text) FROM {source}"),
        ("clean_b", f"SELECT *, string_split({keep_lines('text')}, {NL}) AS ls FROM clean_a"),
        ("clean_c", f"SELECT * EXCLUDE (ls) REPLACE ({UNREPEATED} AS text) FROM clean_b"),
        ("cleaned", f"SELECT * REPLACE ({tidy('text')} AS text) FROM clean_c"),
    ]


for _name, _value in {
    "clean_css": _remove("text", CSS),
    "clean_noise": _remove("text", NOISE),
    "clean_lines": keep_lines("text"),
    "clean_people_sections": people("text"),
    "rejoin_words": rejoin("text"),
    "collapse_blanks": blanks("text"),
    "break_sentences": sentences("text"),
    "compress_blank_lines": blank_lines("text"),
    "strip_line_ends": line_ends("text"),
    "clean_whitespace": tidy("text"),
}.items():
    ORACLES[_name] = with_([NOISY], f"SELECT doc_id, {_value} AS text FROM noisy")
ORACLES["dedupe_lines"] = with_(
    [NOISY, ("split", f"SELECT doc_id, string_split(text, {NL}) AS ls FROM noisy")],
    f"SELECT doc_id, {UNREPEATED} AS text FROM split",
)
ORACLES["clean_text"] = with_([NOISY, *clean_ctes("noisy")], "SELECT doc_id, text FROM cleaned")

# ---------------------------------------------------------------------- policy


def stats_ctes(source: str) -> list[tuple[str, str]]:
    """CTEs that add the statistics of ``text`` to the rows of ``source`` (in ``measured``)."""
    return [
        (
            "stripped",
            f"""SELECT *, list_filter(list_transform(string_split(text, {NL}), lambda l: {strip('l')}), lambda l: l <> '') AS ls
 FROM {source}""",
        ),
        (
            "measured",
            rf"""SELECT * EXCLUDE (ls), length({strip('text')}) AS chars, len(ls) AS lines,
 coalesce(list_sum(list_transform(ls, lambda l: length(l))), 0)::BIGINT AS line_chars,
 len(regexp_extract_all(text, '\S+')) AS words FROM stripped""",
        ),
    ]


def reaches(limit: config.Thresholds) -> str:
    return (
        f"(chars >= {limit.chars} AND lines >= {limit.lines} AND words >= {limit.words} "
        f"AND line_chars / greatest(lines, 1) >= {limit.mean_line})"
    )


GENERAL, RELAXED = config.ContentPolicy().general, config.ContentPolicy().relaxed

ORACLES["doc_stats"] = with_(
    [DOCS, *stats_ctes("docs")],
    """SELECT id, path <> '' AND text <> '' AND category <> '' AS is_valid, chars >= 200 AS has_content,
 url IS NOT NULL AS has_url, chars, lines, line_chars, words FROM measured""",
)
ORACLES["meaningful"] = with_(
    [NOISY, *stats_ctes("noisy")], f"SELECT doc_id, {reaches(GENERAL)} AS meaningful FROM measured"
)
ORACLES["meaningful_for"] = with_(
    stats_ctes("documents"),
    f"SELECT doc_id, CASE WHEN lang = 'en' THEN {reaches(RELAXED)} ELSE {reaches(GENERAL)} END AS meaningful FROM measured",
)
ORACLES["meaningful_policy"] = with_(
    [DOCS, *stats_ctes("docs")],
    f"""SELECT id AS doc_id, CASE WHEN contains(path, 'src3.example.org') AND contains(path, '/fr/') THEN {reaches(t.POLICY.relaxed)}
 ELSE {reaches(t.POLICY.general)} END AS meaningful FROM measured""",
)
ORACLES["clean_and_keep"] = with_(
    [NOISY, *clean_ctes("noisy"), *stats_ctes("cleaned")],
    f"SELECT doc_id, text FROM measured WHERE {reaches(GENERAL)}",
)
ORACLES["empty_text"] = "SELECT doc_id, text FROM documents WHERE lang NOT IN ('fr', 'de') AND " + (
    f"{strip('text')} <> ''"
)
ORACLES["embed_text_cap"] = with_(
    [NOISY],
    f"""SELECT doc_id, length(substr(text, 1, {config.DEFAULT_TEXT_CAP}))::INTEGER AS chars,
 md5(substr(text, 1, {config.DEFAULT_TEXT_CAP})) AS digest FROM noisy""",
)

# ---------------------------------------------------------------------- search

REQUESTS = (
    "requests",
    """SELECT vec_id AS query_id, CASE WHEN label % 2 = 0 THEN lang END AS category, embedding
 FROM embeddings LEFT JOIN documents ON vec_id = doc_id""",
)


def distance(a: str, b: str) -> str:
    return f"list_distance({a}::DOUBLE[], {b}::DOUBLE[])"


def search_ctes(documents: str, vectors: str, requests: str, k: int) -> list[tuple[str, str]]:
    """CTEs with the search results of all requests (in ``found``)."""
    return [
        (
            "scored",
            f"""SELECT r.query_id, d.id AS doc_id, d.path, d.url, d.category, d.text,
 {distance('v.embedding', 'r.embedding')} AS score
 FROM {vectors} v JOIN {documents} d ON v.doc_id = d.id
 JOIN {requests} r ON r.category IS NULL OR r.category = '' OR r.category = d.category""",
        ),
        (
            "ranked",
            "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, doc_id)::INTEGER AS rank FROM scored",
        ),
        ("found", f"SELECT * FROM ranked WHERE rank <= {k}"),
    ]


FOUND = "query_id, rank, doc_id, path, url, category, text, round(score, 6) AS score"
FOUND_SHORT = FOUND.replace(" text,", "")


def _single(category: str | None, k: int) -> str:
    wanted = q(category) if category else "NULL"
    request = (
        "requests",
        f"SELECT 0::BIGINT AS query_id, {wanted}::VARCHAR AS category, embedding FROM embeddings WHERE vec_id = 0",
    )
    return with_([DOCS, VECS, request, *search_ctes("docs", "vecs", "requests", k)], f"SELECT {FOUND} FROM found")


def _many(k: int, final: str, more: tuple = ()) -> str:
    return with_([DOCS, VECS, REQUESTS, *search_ctes("docs", "vecs", "requests", k), *more], final)


ORACLES["index_join"] = with_(
    [DOCS, VECS],
    "SELECT doc_id, category, len(embedding)::INTEGER AS dim FROM vecs JOIN docs ON doc_id = id",
)
ORACLES["l2_distances"] = with_(
    [VECS],
    f"""SELECT v.doc_id, round({distance('v.embedding', 'o.embedding')}, 6) AS score
 FROM vecs v, vecs o WHERE o.doc_id = 0""",
)
ORACLES["vector_search"] = _single(None, 5)
ORACLES["vector_search_category"] = _single("en", 7)
ORACLES["snapshot_search"] = _single("en", 7)
ORACLES["empty_category_snapshot"] = with_(
    [DOCS, VECS],
    """SELECT 'documents' AS part, id, CASE category WHEN 'es' THEN '' ELSE category END AS category, NULL::VARCHAR AS reason FROM docs WHERE category IN ('es', 'en')
 UNION ALL SELECT 'corpus', id, '', NULL FROM docs JOIN vecs ON id = doc_id WHERE category = 'es'
 UNION ALL SELECT 'documents', id, NULL, CASE category WHEN 'de' THEN 'no_category' ELSE 'unknown_category' END FROM docs WHERE category NOT IN ('es', 'en')""",
)
ORACLES["capped_topk"] = _single("de", 10)
ORACLES["pruned_search"] = _single(None, 5)
ORACLES["pruned_search_category"] = _single("en", 7)
ORACLES["batch_topk"] = _many(5, f"SELECT {FOUND_SHORT} FROM found")
ORACLES["batch_topk_blocks"] = _many(10, f"SELECT {FOUND_SHORT} FROM found")
ORACLES["pruned_search_batch"] = _many(10, f"SELECT {FOUND_SHORT} FROM found")
ORACLES["structured_search"] = _many(
    3, "SELECT query_id, rank, path, category, text AS content, round(score, 6) AS score FROM found"
)
ORACLES["result_counts"] = _many(
    10,
    """SELECT r.query_id, count(f.doc_id) AS total_results FROM requests r LEFT JOIN found f
 ON f.query_id = r.query_id GROUP BY r.query_id""",
)


def _rendered(label: str, location: str) -> str:
    block = f"""'=== Result ' || rank || ' (Score: ' || printf('%.4f', score) || ') ===' || {NL}
 || 'Category: ' || category || {NL} || '{label}: ' || {location} || {NL} || {NL}
 || substr(text, 1, 1500) || {NL} || CASE WHEN length(text) > 1500 THEN '...(truncated)' ELSE '' END
 || {NL} || repeat('=', 80) || {NL}"""
    blocks = ("blocks", f"SELECT query_id, rank, {block} AS block FROM found")
    texts = ("texts", f"SELECT query_id, string_agg(block, {NL} ORDER BY rank) AS formatted FROM blocks GROUP BY query_id")
    return _many(
        5,
        """SELECT r.query_id, coalesce(formatted, 'No results found.') AS formatted
 FROM requests r LEFT JOIN texts x ON x.query_id = r.query_id""",
        (blocks, texts),
    )


ORACLES["render_url_form"] = _rendered(
    "URL", f"CASE WHEN url IS NULL OR url = '' THEN {url_from_docs('path')} ELSE url END"
)
ORACLES["render_path_form"] = _rendered("Path", "path")

# ----------------------------------------------------------------- maintenance

STORED = ("stored", "SELECT docs.* FROM docs JOIN vecs ON id = doc_id")
INCOMING = (
    "incoming",
    """SELECT path, 'https://first/' AS url, '* ' || text AS text, category FROM docs WHERE category <> 'fr'
 UNION ALL SELECT path, 'https://second/', text || '!', 'en' FROM docs WHERE category = 'fr'""",
)


def _numbered(paths: str, stored: str) -> tuple[str, str]:
    """CTE that gives the new paths their ids."""
    return (
        "numbered",
        f"""SELECT path, (SELECT coalesce(max(id), 0) FROM {stored})
 + row_number() OVER (ORDER BY substr(md5(path), 1, 3), path) AS id FROM {paths}
 WHERE path NOT IN (SELECT path FROM {stored})""",
    )


ORACLES["upsert"] = with_(
    [DOCS, VECS, STORED, INCOMING, _numbered("incoming", "stored")],
    """SELECT coalesce(s.id, n.id) AS id, i.path, i.url, i.text, i.category FROM incoming i
 LEFT JOIN stored s ON s.path = i.path LEFT JOIN numbered n ON n.path = i.path
 UNION ALL SELECT * FROM stored WHERE path NOT IN (SELECT path FROM incoming)""",
)
ORACLES["upsert_status"] = with_(
    [DOCS, VECS, STORED, INCOMING],
    """SELECT CASE WHEN s.id IS NULL THEN 'new' ELSE 'updated' END AS status, count(*) AS documents
 FROM incoming i LEFT JOIN stored s ON s.path = i.path GROUP BY 1""",
)
ORACLES["save_embeddings"] = """WITH p AS (SELECT vec_id, embedding, unnest(range(64)) AS position FROM embeddings)
SELECT vec_id AS doc_id, position::INTEGER AS position,
 (CASE WHEN vec_id IN (SELECT doc_id FROM documents) THEN -embedding[position + 1] ELSE embedding[position + 1] END)::DOUBLE AS value
FROM p"""
ORACLES["dimension_check"] = """SELECT vec_id AS doc_id, true AS accepted FROM embeddings
UNION ALL SELECT vec_id + 1000000000, false FROM embeddings"""

_KEPT = """SELECT 'documents' AS kept_in, id FROM docs WHERE NOT ({gone})
 UNION ALL SELECT 'vectors', doc_id FROM vecs WHERE doc_id NOT IN (SELECT id FROM docs WHERE {gone})"""
for _name, _gone in {
    "delete_domain": "contains(path, 'src1')",
    "prune_domains": f"NOT {allowed('path')}",
    "prune_skip": skipped("path"),
}.items():
    ORACLES[_name] = with_([DOCS, VECS], _KEPT.replace("{gone}", _gone))
    ORACLES[f"{_name}_count"] = with_(
        [DOCS], f"SELECT count(*) AS deleted_documents FROM docs WHERE {_gone}"
    )
_LABELLED = "SELECT vec_id FROM embeddings WHERE label < 5"
ORACLES["delete_ids"] = with_(
    [DOCS, VECS],
    f"""SELECT 'documents' AS kept_in, id FROM docs WHERE id NOT IN ({_LABELLED})
 UNION ALL SELECT 'vectors', doc_id FROM vecs WHERE doc_id NOT IN ({_LABELLED})""",
)
ORACLES["delete_ids_count"] = with_(
    [DOCS], f"SELECT count(*) AS deleted_documents FROM docs WHERE id IN ({_LABELLED})"
)
ORACLES["backfill_urls"] = with_(
    [DOCS],
    f"SELECT id, path, CASE WHEN url IS NULL OR url = '' THEN {url_from_base('path')} ELSE url END AS url FROM docs",
)
ORACLES["backfill_urls_count"] = with_(
    [DOCS], "SELECT count(*) AS filled_documents FROM docs WHERE url IS NULL OR url = ''"
)
ORACLES["lookup_paths"] = with_(
    [DOCS, PATHS], "SELECT id, path, category FROM docs WHERE path IN (SELECT path FROM paths)"
)
ORACLES["lookup_ids"] = with_(
    [DOCS, VECS], "SELECT id, path, category FROM docs WHERE id IN (SELECT doc_id FROM vecs)"
)

# ------------------------------------------------------------ encoding, build


def hash_ctes(source: str) -> list[tuple[str, str]]:
    """CTEs with the hashed vectors of ``source(doc_id, text)`` (in ``hashed``)."""
    capped = f"substr(text, 1, {config.DEFAULT_TEXT_CAP})"
    return [
        ("words", f"SELECT doc_id, unnest(regexp_extract_all(lower({capped}), '[a-z0-9]+')) AS word FROM {source}"),
        ("word_counts", "SELECT doc_id, word, count(*) AS n FROM words GROUP BY ALL"),
        (
            "placed",
            """SELECT doc_id, (('0x' || substr(md5(word), 1, 8))::BIGINT % 64)::INTEGER AS position,
 CASE WHEN substr(md5(word), 9, 1) < '8' THEN n ELSE -n END AS n FROM word_counts""",
        ),
        ("sums", "SELECT doc_id, position, sum(n)::DOUBLE AS n FROM placed GROUP BY ALL"),
        ("norms", "SELECT doc_id, sqrt(sum(n * n)) AS norm FROM sums GROUP BY doc_id"),
        ("grid", f"SELECT doc_id, unnest(range(64))::INTEGER AS position FROM {source}"),
        (
            "hashed",
            """SELECT doc_id, position, coalesce(n / nullif(norm, 0), 0)::FLOAT AS value
 FROM grid LEFT JOIN sums USING (doc_id, position) LEFT JOIN norms USING (doc_id)""",
        ),
    ]


ORACLES["embed_hashed"] = with_(
    [NOISY, *hash_ctes("noisy")], "SELECT doc_id, position, value::DOUBLE AS value FROM hashed"
)

ORACLES["text_search"] = with_(
    [
        DOCS,
        WEB,
        *html_ctes("web"),
        # Pages have ids below zero here, to be hashed along with the documents.
        (
            "texts",
            "SELECT id AS doc_id, text FROM docs UNION ALL SELECT -1 - seq, text FROM html_text",
        ),
        *hash_ctes("texts"),
        ("all_vectors", "SELECT doc_id, list(value ORDER BY position) AS embedding FROM hashed GROUP BY doc_id"),
        ("requests", "SELECT -1 - doc_id AS query_id, 'en' AS category, embedding FROM all_vectors WHERE doc_id < 0"),
        *search_ctes("docs", "all_vectors", "requests", 3),
    ],
    f"SELECT {FOUND_SHORT} FROM found",
)



def page_ctes(candidates: str) -> list[tuple[str, str]]:
    """CTEs from candidates to ``judged`` and ``saved`` pages.

    The pages of all kinds but Markdown hold HTML, and those with another suffix never pass the scan.
    """
    return [
        ("candidates", candidates),
        *html_ctes("candidates"),
        *clean_ctes("html_text"),
        *stats_ctes("cleaned"),
        (
            "judged",
            f"""SELECT *, CASE WHEN {strip('text')} = '' THEN 'no_text' WHEN NOT {reaches(GENERAL)} THEN 'not_meaningful' END AS reason
 FROM measured""",
        ),
        (
            "saved",
            f"""SELECT path, {url_from_base('path')} AS url, text, {category_of('path')} AS category FROM judged
 WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC) = 1""",
        ),
    ]


PAGES = [DOCS, WEB, *page_ctes(f"SELECT * FROM web WHERE {scanned('path')}")]
BUILT = [
    *PAGES,
    _numbered("saved", "docs"),
    (
        "changed",
        """SELECT coalesce(d.id, n.id) AS id, s.path, s.url, s.text, s.category FROM saved s
 LEFT JOIN docs d ON d.path = s.path LEFT JOIN numbered n ON n.path = s.path""",
    ),
    (
        "built",
        "SELECT * FROM changed UNION ALL SELECT * FROM docs WHERE path NOT IN (SELECT path FROM saved)",
    ),
]
ORACLES["build_documents"] = with_(BUILT, "SELECT id, path, url, text, category FROM built")

_STATS = """SELECT {new} AS new_documents,
 count(*) FILTER (reason IS NULL) - {new} AS updated_documents,
 count(reason) AS skipped_documents,
 count(*) FILTER (reason = 'no_text') AS skipped_no_text,
 count(*) FILTER (reason = 'not_meaningful') AS skipped_not_meaningful,
 count(*) FILTER (reason = 'extract_failed') AS skipped_extract_failed,
 count(*) FILTER (reason IS NULL) AS total_documents,
 count(*) AS candidate_files FROM judged"""
ORACLES["build_stats"] = with_(
    BUILT, _STATS.replace("{new}", "(SELECT count(*) FROM numbered)")
)
ORACLES["rebuild_stats"] = with_(PAGES, _STATS.replace("{new}", "0::BIGINT"))

ORACLES["reject_dim_build"] = with_(
    [*BUILT, VECS],
    """SELECT 'kept' AS part, doc_id AS id, len(embedding)::INTEGER AS dim, NULL::VARCHAR AS reason FROM vecs
 UNION ALL SELECT 'vectors', id, NULL, 'wrong_dimension' FROM changed""",
)
# The index without what the rules leave out, and with all urls, before the pages come.
_GONE = f"(NOT {allowed('path')} OR {skipped('path')})"
_STORED = f"SELECT * REPLACE (CASE WHEN url IS NULL OR url = '' THEN {url_from_base('path')} ELSE url END AS url) FROM all_docs WHERE NOT {_GONE}"
MAINTAINED = [("all_docs", DOCS[1]), ("docs", _STORED), *BUILT[1:]]
ORACLES["maintain_and_build_documents"] = with_(MAINTAINED, "SELECT id, path, url, text, category FROM built")
ORACLES["maintain_and_build_stats"] = with_(
    MAINTAINED,
    f"""SELECT (SELECT count(*) FROM all_docs WHERE NOT {allowed('path')}) AS pruned_domains,
 (SELECT count(*) FROM all_docs WHERE {allowed('path')} AND {skipped('path')}) AS pruned_files,
 (SELECT count(*) FROM all_docs WHERE NOT {_GONE} AND (url IS NULL OR url = '')) AS filled_urls, s.*
 FROM ({_STATS.replace("{new}", "(SELECT count(*) FROM numbered)")}) s""",
)

# Pages as files: a linked file counts as a file, a broken link as one that cannot be read.
FILES = [
    WEB,
    (
        "files",
        f"""SELECT {t.PAGE_FILE_SQL} AS path, {_one_line_end('raw')} AS raw, 0 AS seq, false AS failed FROM web
 UNION ALL SELECT '{t.BASE}{t.LINKED}', {_one_line_end('raw')}, 0, false FROM (FROM web ORDER BY seq LIMIT 1)
 UNION ALL SELECT '{t.BASE}{t.BROKEN}', NULL, 0, true FROM (FROM web LIMIT 1)""",
    ),
]
ORACLES["scan_directory"] = with_(FILES, f"SELECT path, md5(raw) AS digest, failed FROM files WHERE {scanned('path')}")
_read = page_ctes(f"SELECT * EXCLUDE (failed) FROM files WHERE NOT failed AND {scanned('path')}")
ORACLES["files_build"] = with_([*FILES, *_read], "SELECT path, url, text, category FROM saved")
ORACLES["files_build_stats"] = with_(
    [*FILES, *_read, ("broken", f"SELECT count(*) AS n FROM files WHERE failed AND {scanned('path')}")],
    f"""SELECT * EXCLUDE (n) REPLACE (skipped_documents + n AS skipped_documents, n AS skipped_extract_failed, candidate_files + n AS candidate_files)
 FROM ({_STATS.replace('{new}', '(SELECT count(*) FROM saved)')}), broken""",
)

ORACLES["build_and_search"] = with_(
    [
        *BUILT,
        VECS,
        ("texts", "SELECT id AS doc_id, text FROM changed"),
        *hash_ctes("texts"),
        (
            "fresh",
            "SELECT doc_id, list(value ORDER BY position) AS embedding FROM hashed GROUP BY doc_id",
        ),
        (
            "all_vectors",
            "SELECT * FROM fresh UNION ALL SELECT * FROM vecs WHERE doc_id NOT IN (SELECT doc_id FROM fresh)",
        ),
        ("requests", "SELECT doc_id AS query_id, NULL::VARCHAR AS category, embedding FROM fresh"),
        *search_ctes("built", "all_vectors", "requests", 5),
    ],
    f"SELECT {FOUND} FROM found",
)
# Every wave of a stream keeps the last good version of a page; ids are given by part of the paths, wave by wave.
WAVES = [
    WEB,
    *page_ctes(
        " UNION ALL ".join(
            f"SELECT w.* REPLACE ({html} AS raw), {wave} AS wave FROM web w JOIN pages ON seq = page_id WHERE {which} AND {scanned('path')}"
            for wave, (which, html) in enumerate(t.WAVES_SQL)
        )
    )[:-1],
    (
        "versions",
        f"""SELECT path, {url_from_base('path')} AS url, text, {category_of('path')} AS category, wave FROM judged
 WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY path, wave ORDER BY seq DESC) = 1""",
    ),
    ("first_waves", "SELECT path, min(wave) AS first, ('0x' || substr(md5(path), 1, 3))::BIGINT AS part FROM versions GROUP BY path"),
    (
        "given",
        "SELECT path, first, (row_number() OVER (PARTITION BY part ORDER BY first, path) - 1) * 4096 + part + 1 AS id FROM first_waves",
    ),
]
ORACLES["stream_index"] = with_(
    WAVES,
    """SELECT id, path, url, text, category FROM versions JOIN given USING (path)
 QUALIFY row_number() OVER (PARTITION BY path ORDER BY wave DESC) = 1""",
)
_BOTH = """SELECT DISTINCT unnest(['documents', 'vectors']) AS kept_in, id, unnest([path, NULL]) AS path FROM ({rows})"""
_IN_HOST = f"contains(path, '{t.DELETED_HOST}')"
ORACLES["stream_delete"] = with_(
    WAVES, _BOTH.replace("{rows}", f"SELECT id, path FROM given WHERE first = 0 AND NOT {_IN_HOST}")
)
ORACLES["stream_reinsert"] = with_(
    WAVES, _BOTH.replace("{rows}", f"SELECT id, path FROM versions JOIN given USING (path) WHERE NOT {_IN_HOST} OR wave > 0")
)
# Paths that were gone when the index was compacted are new to the stream that follows it.
ORACLES["stream_compact"] = with_(
    [
        *WAVES,
        ("kept", f"SELECT DISTINCT id, path FROM versions JOIN given USING (path) WHERE wave < 2 AND (NOT {_IN_HOST} OR wave = 1)"),
        ("late", "SELECT DISTINCT path, ('0x' || substr(md5(path), 1, 3))::BIGINT AS part FROM versions WHERE wave = 2 AND path NOT IN (SELECT path FROM kept)"),
        ("highest", "SELECT (id - 1) % 4096 AS part, max((id - 1) // 4096 + 1) AS n FROM kept GROUP BY ALL"),
        (
            "after",
            """SELECT id, path FROM kept UNION ALL
 SELECT (coalesce(n, 0) + row_number() OVER (PARTITION BY late.part ORDER BY path) - 1) * 4096 + late.part + 1, path
 FROM late LEFT JOIN highest USING (part)""",
        ),
    ],
    _BOTH.replace("{rows}", "FROM after"),
)
