"""DuckDB SQL for the queries whose whole result SQL can express."""

from __future__ import annotations

from citeloom.llm import chat, licenses

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def license_sql() -> str:
    """The base by looking at each word's successors, the join by counting each block's template words."""
    base, named = [], {}
    for label, phrase in licenses.PHRASES.items():
        words = phrase.split()
        named[label] = " AND ".join(f"w[i{f' + {k}' if k else ''}] = {_quoted(x)}" for k, x in enumerate(words))
        base.append(f"SELECT r, i - 1 AS pos, '{label}' AS label FROM spots WHERE {named[label]}")
    parts = [(k, label, set(licenses._split(t)), [licenses._split(p) for p in naming], licenses.stride(len(licenses._split(t)))) for k, (label, naming, t) in enumerate(licenses.TEMPLATES)]
    values = ", ".join(f"({k}, '{label}', {_quoted(w)}, {len(ws)}, {len(naming)}, {step})" for k, label, ws, naming, step in parts for w in sorted(ws))
    told = " UNION ALL ".join("SELECT r, {k} AS k, {j} AS j, {n} AS n, {step} AS step, i - 1 AS pos FROM spots WHERE ".format(k=k, j=j, n=len(p), step=step) + " AND ".join(f"w[i{f' + {x}' if x else ''}] = {_quoted(word)}" for x, word in enumerate(p)) for k, _, _, naming, step in parts for j, p in enumerate(naming))
    strides = ", ".join(f"({x})" for x in sorted({p[-1] for p in parts}))
    return f"""WITH texts AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
template(k, label, word, n, named, step) AS (VALUES {values}),
spots AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM texts),
base AS ({" UNION ALL ".join(base)}),
places AS (SELECT r, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos, list_sort(list(DISTINCT label)) AS labels FROM base GROUP BY r),
held AS (SELECT r, i - 1 AS pos, w[i] AS word FROM spots WHERE w[i] IN (SELECT word FROM template)),
strides(step) AS (VALUES {strides}),
blocks AS (SELECT r, word, step, pos // step AS b FROM held, strides UNION SELECT r, word, step, pos // step - 1 AS b FROM held, strides WHERE pos >= step),
told AS ({told}), inside AS (SELECT r, k, j, step, pos // step AS b FROM told WHERE pos + n <= (pos // step + 2) * step UNION SELECT r, k, j, step, pos // step - 1 FROM told WHERE pos >= step AND pos + n <= (pos // step + 1) * step),
said AS (SELECT r, k, b, count(DISTINCT j) AS said FROM inside GROUP BY 1, 2, 3),
met AS (SELECT r, b, k, label, n, count(*) AS m, named FROM blocks JOIN template USING (word, step) GROUP BY r, b, k, label, n, named),
best AS (SELECT r, list(DISTINCT label) AS labels, max(m / n) AS score FROM met JOIN said USING (r, b, k) WHERE said = named AND m >= greatest(1, ceil({licenses.THRESHOLD} * n - 1e-9)) GROUP BY r)
SELECT doc_id, CAST(len(w) AS bigint) AS n_words, CAST(coalesce(p.n, 0) AS bigint) AS n_base, CAST(p.first_pos AS bigint) AS first_word, CAST(p.last_pos AS bigint) AS last_word,
  coalesce(array_to_string(p.labels, ','), '') AS base_labels, coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(p.labels, []), coalesce(b.labels, [])))), ','), '') AS labels,
  CASE WHEN p.n > 0 THEN 1.0 ELSE coalesce(b.score, 0.0) END::double AS score
FROM texts LEFT JOIN places p USING (r) LEFT JOIN best b USING (r)"""


#: Base-32 letters of twenty bits at a time: five hex digits give four.
WARC = """WITH payloads AS (SELECT page_id, encode(coalesce(html, '')) AS p FROM pages),
hashed AS (SELECT page_id, octet_length(p) AS n, sha1(p) AS d FROM payloads),
letters AS (SELECT d, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((v >> s) & 31 AS int), 1), '' ORDER BY k, s DESC) AS digest
  FROM (SELECT DISTINCT d, k, CAST(concat('0x', substr(d, 5 * k + 1, 5)) AS bigint) AS v FROM hashed, range(8) t(k)), (VALUES (0), (5), (10), (15)) u(s) GROUP BY d),
last AS (SELECT d, max(page_id) AS top FROM hashed GROUP BY d)
SELECT page_id, CAST(n AS bigint) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM hashed JOIN letters USING (d) JOIN last USING (d)"""


def jaccard_sql(n: int, percent: int) -> str:
    """All pairs of texts with a shingle in common, and what they reach."""
    words = f"list_filter(regexp_split_to_array({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
    shingle = " || chr(31) || ".join(f"w[i + {k}]" if k else "w[i]" for k in range(n))
    return f"""WITH RECURSIVE texts AS (SELECT doc_id, {words} AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, {shingle} AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM texts WHERE len(w) >= {n})
  UNION SELECT doc_id, array_to_string(w, chr(31)) FROM texts WHERE len(w) BETWEEN 1 AND {n - 1}),
sized AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM met JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b WHERE 100 * common >= {percent} * (x.n + y.n - common)),
reach AS (SELECT doc_id, doc_id AS other FROM texts UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM texts LEFT JOIN sized USING (doc_id) JOIN least USING (doc_id)"""


def chat_sql() -> str:
    """The three renderings of a conversation, and the first that the grammar gives back."""
    marks = chat.MARKS
    control = chat._CONTROL

    def lines(s: str) -> str:
        return "concat(" + ", chr(10), ".join(_quoted(part) for part in s.split("\n")) + ")"

    def rendered(level: int) -> str:
        text = {0: "x.text", 1: f"regexp_replace(x.text, '([<\\[])(\\\\*){control}', '\\1\\\\\\2\\3', 'g')", 2: "regexp_replace(x.text, '([<\\[])', '\\1\\\\', 'g')"}[level]
        cases = " ".join(f"WHEN x.role = '{role}' THEN concat({lines(a)}, {text}, {lines(b)})" for role, (a, b) in marks.items())
        other = f"concat({lines(chat.OTHER[0])}, hex(x.role), {lines(chat.OTHER[1])}, {text}, {lines(chat.OTHER[2])})"
        return f"array_to_string(list_transform(turns, lambda x: CASE {cases} ELSE {other} END), '')"

    def parsed(body: str) -> str:
        cases = " ".join(f"WHEN starts_with(x, {lines(marks[r][0])}) THEN {{'role': '{r}', 't': substr(x, {len(marks[r][0]) + 1}, len(x) - {len(''.join(marks[r]))})}}" for r in ("user", "assistant", "system"))
        other = "{'role': decode(unhex(regexp_extract(x, '^<<ROLE ([0-9A-F]*)>>', 1))), 't': regexp_extract(x, '(?s)^<<ROLE [0-9A-F]*>>\\n(.*)\\n<</ROLE>>\\n$', 1)}"
        parts = f"regexp_extract_all({body}, {_quoted(chat._TURN)})"
        undone = f"regexp_replace(y.t, '([<\\[])\\\\(\\\\*){control}', '\\1\\2\\3', 'g')"
        return f"CASE WHEN array_to_string({parts}, '') = {body} THEN list_transform(list_transform({parts}, lambda x: CASE {cases} ELSE {other} END), lambda y: {{'role': y.role, 'text': {undone}}}) END"

    return f"""WITH lines AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
talks AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, encode(role), encode(text)) AS turns FROM lines GROUP BY 1),
made AS (SELECT conv_id, turns, {rendered(0)} AS f0, {rendered(1)} AS f1, {rendered(2)} AS f2 FROM talks),
read AS (SELECT *, coalesce({parsed('f0')} = turns, false) AS same0, coalesce({parsed('f1')} = turns, false) AS same1 FROM made)
SELECT conv_id, CAST(len(turns) AS bigint) AS n_turns, sha256(array_to_string(list_transform(turns, lambda x: concat(x.role, chr(10), x.text, chr(10))), '')) AS turns_sha256,
  CAST(len(array_to_string(list_transform(list_filter(turns, lambda x: x.role = 'assistant'), lambda x: x.text), '')) AS bigint) AS loss_chars,
  sha256(array_to_string(list_transform(list_filter(turns, lambda x: x.role = 'assistant'), lambda x: x.text), '')) AS loss_sha256,
  CAST(CASE WHEN same0 THEN len(f0) WHEN same1 THEN len(f1) ELSE {len(chat.HEADER)} + len(f2) END AS bigint) AS formatted_chars
FROM read"""


#: CRC-32 by its table: 256 entries of eight divisions each, then a byte at a time for each distinct word.
RESAMPLING = f"""WITH crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
texts AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
aim AS (SELECT unnest(list_filter(regexp_split_to_array({_LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')) AS word FROM benchmark),
met AS (SELECT r, unnest(w) AS word FROM texts),
spelt AS (SELECT word, list_transform(range(octet_length(encode(word))), lambda k: CAST(concat('0x', substr(hex(encode(word)), 2 * k + 1, 2)) AS bigint)) AS bytes FROM (SELECT word FROM met UNION SELECT word FROM aim)),
hashed AS (SELECT word, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM spelt, crc),
counted AS (SELECT bucket, count(*) AS s FROM met JOIN hashed USING (word) GROUP BY 1),
aimed AS (SELECT bucket, count(*) AS t FROM aim JOIN hashed USING (word) GROUP BY 1),
gains AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::double * ((SELECT count(*) FROM met) + 10000)::double / ((coalesce(s, 0) + 1)::double * ((SELECT count(*) FROM aim) + 10000)::double))) AS bigint) AS gain
  FROM (SELECT DISTINCT bucket FROM hashed) LEFT JOIN counted USING (bucket) LEFT JOIN aimed USING (bucket)),
summed AS (SELECT r, CAST(floor(sum(gain) / count(*)::double) AS bigint) AS weight FROM met JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY 1),
scored AS (SELECT doc_id, CAST(len(w) AS bigint) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(concat('0x', substr(sha256(concat('2024:', doc_id)), 1, 8)) AS bigint) + 0.5::double) / 4294967296::double))) AS bigint) AS score FROM texts LEFT JOIN summed USING (r)),
placed AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * (SELECT count(*) FROM scored WHERE n_features >= 20) // 100 THEN place END AS rank FROM placed"""


def collocation_sql(most: int, least: int, share: int, top: int) -> str:
    """All n-grams counted, joined with their parts, and those inside longer ones looked up."""
    grams = " UNION ALL ".join(f"SELECT lang, {n} AS size, {' || chr(32) || '.join(f'w[i + {k}]' if k else 'w[i]' for k in range(n))} AS phrase, count(*) AS f FROM (SELECT lang, w, unnest(range(1, len(w) - {n - 2})) AS i FROM pieces WHERE len(w) >= {n}) GROUP BY 1, 3" for n in range(1, most + 1))
    return f"""WITH texts AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
pieces AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM texts),
words AS (SELECT lang, sum(len(w))::bigint AS n FROM pieces GROUP BY 1),
grams AS ({grams}),
found AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE size > 1 AND f >= {least}),
cuts AS (SELECT *, array_to_string(w[1:k], ' ') AS one, array_to_string(w[k + 1:], ' ') AS two FROM (SELECT *, unnest(range(1, size)) AS k FROM found)),
scored AS (SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, (1000000::hugeint * a * a) // (x.f::hugeint * y.f) AS score FROM cuts c JOIN grams x ON x.lang = c.lang AND x.phrase = one JOIN grams y ON y.lang = c.lang AND y.phrase = two),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (SELECT lang, a AS longer, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, size - n + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS n FROM found))),
kept AS (SELECT * FROM weakest w WHERE NOT EXISTS (SELECT 1 FROM inner_ i WHERE i.lang = w.lang AND i.phrase = w.phrase AND 100 * i.longer >= {share} * w.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::bigint AS score FROM kept JOIN words USING (lang)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= {top}"""


#: All pairs of vectors of one label, and what they reach.
NEARDUP = """WITH RECURSIVE usable AS (SELECT vec_id, label, CAST(embedding AS double[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other),
least AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN least USING (vec_id)"""


SQL = {"op12_neardup": NEARDUP, "op11_collocations": collocation_sql(3, 10, 50, 2000), "op13_resampling": RESAMPLING, "op2_licenses": license_sql(), "op3_warc": WARC, "op7_jaccard": jaccard_sql(3, 90), "op10_chat": chat_sql()}
