"""SQL that says what the queries of this subpackage return, where SQL can.

The others learn a model, walk an automaton, write a binary form or need a library's own
segmentation; tests hold them against plain versions.
"""

from __future__ import annotations

NGRAM_JOIN = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text,'')), '\s+'), lambda x: x<>'') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, CASE WHEN len(ws)<5 THEN array_to_string(ws,' ') ELSE array_to_string(ws[i:i+4],' ') END AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws)-4,1)+1)) AS i FROM w WHERE len(ws)>0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
inter AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s=b.s AND a.doc_id<>b.doc_id GROUP BY 1,2),
links AS (SELECT x, y, nx.n=ny.n AND c=nx.n AS same FROM inter JOIN n nx ON nx.doc_id=x JOIN n ny ON ny.doc_id=y WHERE c*1800 >= 800*(nx.n+ny.n)),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y=l.x),
groups AS (SELECT x, least(x, min(y)) AS class_id FROM reach GROUP BY x),
counts AS (SELECT x, count(*) AS n_links, count(*) FILTER (same) AS copies FROM links GROUP BY x)
SELECT d.doc_id, coalesce(g.class_id, d.doc_id) AS class_id, coalesce(c.n_links,0) AS n_links, coalesce(c.copies,0)+1 AS n_copies, coalesce(n.n,0) AS n_shingles
FROM documents d LEFT JOIN groups g ON g.x=d.doc_id LEFT JOIN counts c ON c.x=d.doc_id LEFT JOIN n ON n.doc_id=d.doc_id"""

_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

SECRET_SCAN = rf"""WITH d AS (SELECT doc_id, coalesce(text,'') AS t FROM documents),
m AS (SELECT doc_id, 0 AS k, 'assign' AS kind, 6 AS least_, regexp_extract_all(t, '{_ASSIGN}') AS ms, regexp_extract_all(t, '{_ASSIGN}', 2) AS gs, string_split_regex(t, '{_ASSIGN}') AS ps FROM d
 UNION ALL SELECT doc_id, 1, 'access', 20, regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+'), string_split_regex(t, 'AKIA[A-Z0-9]+') FROM d
 UNION ALL SELECT doc_id, 2, 'hex', 24, regexp_extract_all(t, '[0-9a-f]{{24,}}'), regexp_extract_all(t, '[0-9a-f]{{24,}}'), string_split_regex(t, '[0-9a-f]{{24,}}') FROM d),
i AS (SELECT *, unnest(range(1, len(ms)+1)) AS i FROM m),
s AS (SELECT doc_id, k, kind, list_sum(list_transform(ps[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda z: length(z))),0) AS s, length(ms[i]) AS n FROM i WHERE length(gs[i]) >= least_),
a AS (SELECT doc_id, count(*) FILTER (k=0) AS n_assign, count(*) FILTER (k=1) AS n_access, count(*) FILTER (k=2) AS n_hex, string_agg(kind||':'||CAST(s AS BIGINT)||':'||CAST(s+n AS BIGINT), ',' ORDER BY s, k) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign,0) AS n_assign, coalesce(n_access,0) AS n_access, coalesce(n_hex,0) AS n_hex, sha256(coalesce(spans,'')) AS base_sha256, coalesce(spans,'') AS spans, sha256(t) AS blob FROM d LEFT JOIN a ON a.doc_id=d.doc_id"""

_LENGTH = r"(length({x}) + length({x}) - length(replace({x}, chr(92), '')) + len(regexp_extract_all({x}, '<\|turn\|>|<\|text\|>|<\|end\|>|</?s>|\[/?INST\]|<</?SYS>>')))"

CHAT_FORMAT = rf"""WITH c AS (SELECT conv_id, turn, coalesce(role,'') AS role, coalesce(text,'') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role||chr(10)||text||chr(10), '' ORDER BY turn, role, text) AS turns, coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role='assistant'),'') AS loss,
 CAST(sum({_LENGTH.format(x='role')} + {_LENGTH.format(x='text')} + 24) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, false AS rewrites FROM g"""

SUBSTRING_DEDUP = r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text,''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, p, sha256(array_to_string(ws[p:p+49],' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws)-48)) AS p FROM w WHERE len(ws)>=50)),
l AS (SELECT h, min(doc_id) AS least_ FROM p GROUP BY h HAVING min(doc_id)<max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p+50)) AS i FROM p JOIN l USING (h) WHERE doc_id>least_),
kept AS (SELECT x.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY x.i) AS text FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws)+1)) AS i FROM w) x LEFT JOIN gone g ON g.doc_id=x.doc_id AND g.i=x.i WHERE g.i IS NULL GROUP BY x.doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws)-coalesce(k.n,0) AS n_removed, sha256(coalesce(k.text,'')) AS kept_sha256 FROM w LEFT JOIN kept k ON k.doc_id=w.doc_id"""
