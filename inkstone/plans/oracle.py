"""SQL of the catalogue's queries, written on its own from their definitions."""

from __future__ import annotations

WS = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
S, D = f"[{WS}]", "[0-9０-９]"
MARKS = r"，,。.；;：:！!？?（）()【】\[\]《》<>“”\""  "''" r"‘’、"
KEEP = rf"\x{{4e00}}-\x{{9fa5}}a-zA-Z0-9{WS}.,;:!?()\[\]{{}}+\-*/=><\^％%×÷√≤≥≈∑∏π·_∠°′″→|‖∥⊥∈∉⊂⊆⊇∪∩±≡≠"
POINTS = "['数列', '概率', '统计']"
DIM = {"embeddings": 64, "questions": 16}


def rep(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"


def trim(x: str) -> str:
    return rep(x, f"^{S}+|{S}+$")


def group(x: str, pattern: str) -> str:
    return f"nullif(regexp_extract({x}, '{pattern}', 1), '')"


def any_of(x: str, words: str) -> str:
    return "coalesce(" + " OR ".join(f"contains({x}, '{w}')" for w in words.split()) + ", false)"


def count_of(x: str, words: str) -> str:
    return "(" + " + ".join(f"coalesce(contains({x}, '{w}')::int, 0)" for w in words.split()) + ")"


def digits(x: str) -> str:
    return f"translate({x}, '０１２３４５６７８９', '0123456789')"


def normal(x: str) -> str:
    return rep(f"lower(coalesce({x}, ''))", f"[{WS}{MARKS}]")


def question(x: str) -> str:
    t = trim(f"coalesce({x}, '')")
    return normal(rep(t, rf"^{S}*\(?{S}*{D}+{S}*\)?{S}*[.、]{S}*"))


def in_range(x: str) -> str:
    n = f"try_cast({x} AS bigint)"
    return f"CASE WHEN {n} BETWEEN 1 AND 200 THEN {n}::varchar END"


def number_record(x: str) -> str:
    t = trim(x)
    plain = digits(group(t, rf"^({D}{{1,4}}){S}*(?:[.、)．]|{S})"))
    return f"CASE WHEN {plain} IS NOT NULL THEN {in_range(plain)} ELSE {group(t, rf'^\({S}*({D}+){S}*\)')} END"


def number_upload(x: str) -> str:
    t = rep(trim(x), f"^[{WS}\"''“”‘’]+")
    plain = digits(group(t, rf"^({D}{{1,4}}){S}*(?:[.、)．]|{S})"))
    return f"CASE WHEN {plain} IS NOT NULL THEN {in_range(plain)} ELSE {in_range(digits(group(t, rf'^\({S}*({D}{{1,4}}){S}*\)')))} END"


def stable(doc: str, x: str) -> str:
    return f"coalesce({doc}, '') || ':' || coalesce({number_upload(x)}, 'h:' || md5({question(x)}))"


def meta_text(field: str, needle: str) -> str:
    return f"contains(lower({trim(f"coalesce(source_meta.{field}, '')")}), '{needle}')"


def clean(x: str) -> str:
    for p in (f"---{S}*第{S}*{D}+{S}*页{S}*---", f"第{S}*{D}+{S}*页{S}*/{S}*共{S}*{D}+{S}*页", f"第{S}*{D}+{S}*页", f"共{S}*{D}+{S}*页"):
        x = rep(x, p)
    return trim(rep(rep(x, r"\n{3,}", "\n\n"), f"[^{KEEP}]"))


def ideographs(x: str) -> str:
    x = rep(f"replace({x}, chr(160), ' ')", r"[ \t]+", " ")
    for _ in range(2):
        x = rep(x, rf"([\x{{4e00}}-\x{{9fa5}}]){S}+([\x{{4e00}}-\x{{9fa5}}])", r"\1\2")
    return rep(x, r"\n{3,}", "\n\n")


def dot(a: str, b: str, n: int) -> str:
    return f"list_sum(list_transform(range(1, {n + 1}), lambda i: {a}[i]::double * {b}[i]::double))"


def cosine(a: str, b: str, n: int) -> str:
    return f"{dot(a, b, n)} / ((sqrt({dot(a, a, n)}) + 1e-8) * (sqrt({dot(b, b, n)}) + 1e-8))"


def close(a: str, b: str, n: int) -> str:
    return f"1 / (1 + list_sum(list_transform(range(1, {n + 1}), lambda i: ({a}[i]::double - {b}[i]::double) * ({a}[i]::double - {b}[i]::double))))"


def lines(x: str) -> str:
    ends = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
    return f"list_filter(list_transform(regexp_split_to_array({x}, '{ends}'), lambda s: {trim('s')}), lambda s: s <> '')"


def retrieval(lo: int, hi: int) -> str:
    return f"coalesce(list_has_any(knowledge_points, {POINTS}), false) AND coalesce(difficulty, 3) BETWEEN {lo} AND {hi}"


def top(n: int, where: str, score: str, first: str = "questions", key: str = "seq", dim: int = 16) -> str:
    v = f"(SELECT embedding FROM {first} WHERE embedding IS NOT NULL ORDER BY {key} LIMIT 1)"
    return (
        f"WITH q AS MATERIALIZED (SELECT {v} AS qv), s AS (SELECT t.*, {score} AS sim FROM {first} t, q WHERE embedding IS NOT NULL AND {where}) "
        f"SELECT {key}, round(sim, 5) AS similarity, row_number() OVER (ORDER BY sim DESC, {key})::int AS rank FROM s ORDER BY sim DESC, {key} LIMIT {n}"
    )


FIRST_LINES = f"WITH l AS (SELECT doc_id, {lines('text')} AS ls FROM documents), h AS (SELECT doc_id, ls, array_to_string(coalesce(ls, [])[1:30], chr(10)) AS h FROM l)"
GRADES, KINDS = "高一 高二 高三 初一 初二 初三", "期中 期末 月考 模拟 一模 二模 三模 联考"
YEAR = f"CAST({digits("coalesce(" + ", ".join(group('h', p) for p in (rf'(20{D}{{2}}){S}*年', rf'(20{D}{{2}}){S}*[-—–~至一]{S}*20{D}{{2}}{S}*学年', rf'(20{D}{{2}}){S}*[-—–~]{S}*20{D}{{2}}')) + ")")} AS int)"
FIRST_OF = lambda words: "CASE " + " ".join(f"WHEN contains(h, '{w}') THEN '{w}'" for w in words.split()) + " END"
REGION = group("h", r"([\x{4e00}-\x{9fa5}]{2,8}(?:市|省|自治区|区|县))")
META = f"{FIRST_LINES}, m AS (SELECT doc_id, ls, {YEAR} AS year, {FIRST_OF(GRADES)} AS grade, {FIRST_OF(KINDS)} AS source_type, {REGION} AS region FROM h)"
NAMES = "考试|试卷|试题|检测|测验|联考|月考|期中|期末"
TITLED = (
    META + ", c AS (SELECT m.*, s, i FROM m, LATERAL (SELECT unnest(coalesce(ls, [])[1:25]) AS s, generate_subscripts(coalesce(ls, [])[1:25], 1) AS i)), "
    "sc AS (SELECT doc_id, s, i, 2 * coalesce(contains(s, grade), false)::int + 2 * coalesce(contains(s, source_type), false)::int + 2 * coalesce(contains(s, year::varchar), false)::int "
    f"+ contains(s, '学年')::int + contains(s, '数学')::int AS score FROM c WHERE length(s) <= 90 AND regexp_matches(s, '{NAMES}')), "
    "b AS (SELECT doc_id, arg_max(s, (score, -i)) AS s, max(score) AS score FROM sc GROUP BY doc_id)"
)
STARTS = rf"(^|\n)({D}+[.、]{S}+|\({D}+\){S}+|[一二三四五六七八九十]+[、．]{S}+)"
SEGMENTS = (
    f"WITH p AS (SELECT doc_id, string_split({rep('text', STARTS, chr(92) + '1' + chr(1) + chr(92) + '2')}, chr(1))[2:] AS ps FROM documents WHERE text IS NOT NULL), "
    f"k AS (SELECT doc_id, list_transform(list_filter(list_transform(ps, lambda s: {trim('s')}), lambda s: length(s) >= 30), lambda s: {rep('s', f'[{WS}]+', ' ')}) AS ks FROM p), "
    "seg AS (SELECT doc_id, unnest(ks) AS segment, generate_subscripts(ks, 1) AS segment_no FROM k)"
)
WORDS = "答卷前 答题卡 考生号 考场号 座位号 填写在 选择题时 选出 涂黑 如需改动 用橡皮擦 非选择题 黑色字迹 签字笔 答在 答题区域 超出答题区域 在草稿纸 试卷上 均无效 考试时间 满分 注意事项 本试卷 第 页 共 页 姓名 班级 学号"


def instruction(x: str) -> str:
    return (
        f"((length({x}) < 100 AND {count_of(f'lower({x})', WORDS)} >= 2) OR {any_of(f'lower({x})', '答题卡 考生号 考场号 座位号')} "
        f"OR (length({x}) < 150 AND {any_of(f'lower({x})', '本题共 多项选择 部分选对 全部选对 有选错 每小题')}))"
    )


def kind(x: str) -> str:
    return (
        rf"CASE WHEN regexp_matches(lower({x}), '[a-dＡ-Ｄ]{S}*[\\.|、)]') THEN '选择题' WHEN {any_of(x, '____ ___ （） ()')} OR {any_of(f'lower({x})', '填空 填入 填在 空格')} THEN '填空题' "
        f"WHEN {any_of(f'lower({x})', '解答 求 证明 计算 应用')} THEN '解答题' ELSE '未知题型' END"
    )


def complete(x: str) -> str:
    t = trim(x)
    return (
        rf"coalesce(length({t}) >= 30 AND regexp_matches({t}, '^{D}+[.、)]|^[一二三四五六七八九十]+[、．]|^\(?{D}+\)') "
        rf"AND (NOT {any_of(f'lower({t})', '选择 正确的是 错误的是 哪个')} OR regexp_matches({t}, '[A-Z][.、)]')) "
        rf"AND regexp_matches({t}, '[0-9+\-×÷=<>≤≥≠√∑∏∫]|[a-z][²³]|[函数方程集合]'), false)"
    )


def sub(x: str) -> str:
    return rf"coalesce(regexp_matches({trim(x)}, '^\({S}*{D}+{S}*\)'), false)"


def one_line(x: str) -> str:
    return rep(x.replace("{0}", "''"), "[\\r\\n\\t]+", " ")


def kept(x: str) -> str:
    return f"({complete(x)} OR coalesce({number_record(x)} IS NOT NULL AND length({trim(x)}) >= 20, false))"


def group_counts(by: str, where: str, n: int) -> str:
    k = trim(f"source_meta.{by}::varchar")
    return (
        f"WITH g AS (SELECT CASE WHEN {k} IS NULL OR {k} IN ('', '0') THEN '(empty)' ELSE {k} END AS key, count(*) AS count, min(seq) AS f FROM questions WHERE {where} GROUP BY 1) "
        f"SELECT key, count, row_number() OVER (ORDER BY count DESC, f)::int AS rank FROM g ORDER BY count DESC, f LIMIT {n}"
    )


def sql() -> dict[str, str]:
    flt = f"{meta_text('region', '青坡')} AND {meta_text('source_type', '期')} AND source_meta.year = 2021"
    staged = (
        f"WITH k AS (SELECT seq, {stable('doc_hash', 'content')} AS id, content FROM incoming_records), f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS r FROM k), "
        "t AS (SELECT seq, id, content, CASE WHEN r > 1 THEN 'internal_exact' WHEN id IN (SELECT id FROM questions WHERE id IS NOT NULL) THEN 'db_existing_id' END AS reason FROM f)"
    )
    parts = (
        "WITH q AS MATERIALIZED (SELECT (SELECT embedding FROM questions WHERE embedding IS NOT NULL ORDER BY seq LIMIT 1) AS qv), "
        f"s AS (SELECT t.*, {cosine('embedding', 'qv', 16)} AS sim FROM questions t, q WHERE embedding IS NOT NULL AND {retrieval(1, 5)}), "
        "h AS (SELECT *, row_number() OVER (ORDER BY sim DESC, seq) AS rk FROM s ORDER BY rk LIMIT 13), "
        "ex AS (SELECT *, row_number() OVER (ORDER BY rk) AS number FROM h WHERE coalesce(difficulty, 3) BETWEEN 2 AND 4 ORDER BY rk LIMIT 3), "
        "pr AS (SELECT *, row_number() OVER (ORDER BY rk) AS number FROM h WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.content = h.content) ORDER BY rk LIMIT 5), "
        "b AS (SELECT 'example' AS part, * FROM ex UNION ALL SELECT 'practice', * FROM pr)"
    )
    user = ", ".join(f"coalesce(nullif(source_meta.{f}, {0 if f == 'year' else chr(39) * 2}), m.{f}) AS {f}" for f in ("region", "year", "grade", "exam_name", "source_type"))
    tm = lambda f: trim(f"source_meta.{f}::varchar")
    built = f"CASE WHEN {tm('year')} <> '' THEN {tm('year')} || '年' ELSE '' END || coalesce(nullif({tm('region')}, ''), '') || coalesce(nullif({tm('source_type')}, ''), '')"
    sure = {"year": "0.95", "grade": "0.9", "source_type": "0.85", "region": "0.75"}
    low = ", ".join(f"CASE WHEN {c} THEN '{f}' END" for f, c in (
        ("region", "region IS NULL"), ("year", "year IS NULL"), ("grade", "grade IS NULL"), ("exam_name", "coalesce(b.score, 0) < 2"), ("source_type", "source_type IS NULL")))
    nums = (
        rf"WITH n AS (SELECT doc_id, list_max(list_filter(list_transform(regexp_extract_all(text, '(?:^|\n){S}*({D}+){S}*[.、)]', 1), lambda s: try_cast({digits('s')} AS bigint)), "
        "lambda x: x BETWEEN 1 AND 200)) AS m FROM documents), e AS (SELECT doc_id, unnest(range(1, m + 1)) AS number FROM n WHERE m IS NOT NULL), " + SEGMENTS.removeprefix("WITH ")
    )
    latest = "(SELECT import_id, any_value(pdf_hash) AS pdf_hash, max(extracted_total) AS extracted_total, max(added) AS added, max(duplicates_removed) AS duplicates_removed FROM import_history GROUP BY import_id)"
    item = (
        "'<div class=\"question\"><h3>第' || n || '题</h3><p>' || coalesce(content, '') || '</p>' || "
        "CASE WHEN len(list_filter(coalesce(images, []), lambda p: p <> '')) > 0 THEN '<div class=\"image-container\">' || array_to_string(list_transform(list_filter(images, lambda p: p <> ''), "
        "lambda p: '<img src=\"' || p || '\" class=\"question-image\" alt=\"题目图片\" />'), '') || '</div>' ELSE '' END || "
        + " || ".join(f"CASE WHEN coalesce({c}, '') <> '' THEN '<div class=\"answer\"><strong>{n}：</strong>' || {c} || '</div>' ELSE '' END" for n, c in (("答案", "answer"), ("解析", "solution")))
        + " || '</div>'"
    )
    style = "<style>body{max-width:46rem;margin:2rem auto;line-height:1.7}h1{font-size:1.4rem}.question{border-top:1px solid #ccc}.answer{border-left:3px solid #888;padding-left:.6rem}</style>"
    points = rf"list_filter(list_transform(regexp_split_to_array(array_to_string(knowledge_points, '、'), '[\n,，、;；]+'), lambda s: {trim('s')}), lambda s: s <> '')"
    form = question("c")
    return {
        "scan_page_query": "SELECT seq, id, question_type, coalesce(array_to_string(knowledge_points, '|'), '') AS points, coalesce(difficulty, 3) AS difficulty, source_meta.region AS region, substr(content, 1, 200) AS content_preview FROM questions ORDER BY seq LIMIT 20 OFFSET 40",
        "meta_filter": f"SELECT seq, id, source_meta.region AS region, source_meta.source_type AS source_type FROM questions WHERE {flt}",
        "meta_filter_id": f"SELECT seq, id FROM questions WHERE {meta_text('grade', '初')} AND id = (SELECT arg_min(id, seq) FROM questions WHERE id IS NOT NULL AND {meta_text('grade', '初')})",
        "match_total": f"SELECT count(*) FILTER ({flt}) AS matched, count(*) AS total FROM questions",
        "retrieval_filter": f"SELECT seq, difficulty FROM questions WHERE {retrieval(2, 4)}",
        "retrieval_filter_empty": "SELECT seq, difficulty FROM questions WHERE false",
        "first_point_filter": "SELECT seq FROM questions WHERE list_contains(knowledge_points, '数列')",
        "group_counts_region": group_counts("region", "true", 50),
        "group_counts_year": group_counts("year", meta_text("region", "市"), 10),
        "group_counts_source_type": group_counts("source_type", "source_meta.year = 2020", 30),
        "group_counts_lang": f"SELECT CASE WHEN {trim('lang')} IS NULL OR {trim('lang')} IN ('', '0') THEN '(empty)' ELSE {trim('lang')} END AS key, count(*) AS count, min(doc_id) AS first, sum(n_chars)::bigint AS chars FROM documents GROUP BY 1",
        "store_stats": "SELECT count(*) AS total, 'parquet' AS backend, CASE WHEN count(*) > 0 THEN 'ready' ELSE 'empty' END AS status FROM questions",
        "exact_dedupe_first_wins": f"SELECT min(seq) AS seq, md5({normal('content')}) AS content_key FROM questions GROUP BY 2",
        "stable_key_dedupe": f"SELECT seq, {stable('doc_hash', 'content')} AS id, row_number() OVER (PARTITION BY {stable('doc_hash', 'content')} ORDER BY seq) = 1 AS kept FROM incoming_records",
        "existing_ids_semi": "SELECT seq, id FROM incoming_records WHERE id IN (SELECT id FROM questions WHERE id IS NOT NULL)",
        "new_ids_anti": "SELECT seq, id FROM incoming_records i WHERE NOT EXISTS (SELECT 1 FROM questions q WHERE q.id = i.id)",
        "insert_dedupe": "SELECT seq, id FROM (SELECT seq, id, row_number() OVER (PARTITION BY id ORDER BY seq) AS r FROM incoming_records i WHERE NOT EXISTS (SELECT 1 FROM questions q WHERE q.id = i.id)) WHERE r = 1 OR id IS NULL",
        "dedupe_first_stages": staged + " SELECT seq, id, reason FROM t",
        "knn_top10_cosine": top(10, "true", cosine("embedding", "qv", 64), "embeddings", "vec_id"),
        "knn_top3_l2": f"WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbour_id, {close('a.embedding', 'b.embedding', 64)} AS s FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0), "
        "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, neighbour_id)::int AS rank FROM p) SELECT query_id, neighbour_id, round(s, 5) AS similarity, rank FROM r WHERE rank <= 3",
        "knn_prefilter": top(10, retrieval(2, 4), cosine("embedding", "qv", 16)),
        "knn_postfilter_overfetch": "WITH q AS MATERIALIZED (SELECT (SELECT embedding FROM questions WHERE embedding IS NOT NULL ORDER BY seq LIMIT 1) AS qv), "
        f"s AS (SELECT t.*, {close('embedding', 'qv', 16)} AS sim FROM questions t, q WHERE embedding IS NOT NULL ORDER BY sim DESC, seq LIMIT 20) "
        f"SELECT seq, round(sim, 5) AS similarity, row_number() OVER (ORDER BY sim DESC, seq)::int AS rank FROM s WHERE {retrieval(2, 4)} ORDER BY sim DESC, seq LIMIT 10",
        "knn_first_point": top(10, "list_contains(knowledge_points, '数列')", close("embedding", "qv", 16)),
        "knn_questions": f"WITH p AS (SELECT a.seq AS query_id, b.seq AS neighbour_id, {cosine('a.embedding', 'b.embedding', 16)} AS s FROM questions a, questions b WHERE a.seq % 20 = 0 AND a.seq <> b.seq AND a.embedding IS NOT NULL AND b.embedding IS NOT NULL), "
        "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, neighbour_id)::int AS rank FROM p) SELECT query_id, neighbour_id, round(s, 5) AS similarity, rank FROM r WHERE rank <= 3",
        "examples_practice_split": parts + " SELECT part, number::int AS number, seq, round(sim, 5) AS similarity FROM b",
        "handout_render": parts + ", x AS (SELECT part, string_agg('**' || CASE part WHEN 'example' THEN '例' ELSE '练习' END || number || '** （难度 ' || coalesce(difficulty, 3) || '/5）' || chr(10) || coalesce(content, ''), chr(10) || chr(10) ORDER BY number) AS t FROM b GROUP BY part) "
        "SELECT '# 数列与概率' || chr(10) || chr(10) || string_agg('## ' || CASE part WHEN 'example' THEN '例题' ELSE '练习' END || chr(10) || chr(10) || t, chr(10) || chr(10) ORDER BY part) AS markdown FROM x",
        "handout_html": parts + ", x AS (SELECT part, string_agg('**' || CASE part WHEN 'example' THEN '例' ELSE '练习' END || number || '** （难度 ' || coalesce(difficulty, 3) || '/5）' || chr(10) || coalesce(content, ''), chr(10) || chr(10) ORDER BY number) AS t FROM b GROUP BY part), "
        "y AS (SELECT '# 数列与概率' || chr(10) || chr(10) || string_agg('## ' || CASE part WHEN 'example' THEN '例题' ELSE '练习' END || chr(10) || chr(10) || t, chr(10) || chr(10) ORDER BY part) AS t FROM x), "
        r"z AS (SELECT list_filter(regexp_split_to_array(regexp_replace(t, '\*\*([^*]+)\*\*', '<b>\1</b>', 'g'), '\n{2,}'), lambda s: s <> '') AS l FROM y) "
        "SELECT md5(array_to_string(list_transform(l, lambda s: CASE WHEN starts_with(s, '# ') THEN '<h1>' || s[3:] || '</h1>' WHEN starts_with(s, '## ') THEN '<h2>' || s[4:] || '</h2>' "
        "ELSE '<p>' || replace(s, chr(10), '<br>') || '</p>' END), chr(10))) AS html_md5 FROM z WHERE l IS NOT NULL",
        "delete_dry_run": f"SELECT count(*) FILTER ({meta_text('region', '云滩')}) AS matched, count(*) FILTER (NOT {meta_text('region', '云滩')}) AS remaining, "
        f"(SELECT string_agg(id, '|' ORDER BY seq) FROM (SELECT id, seq FROM questions WHERE id IS NOT NULL AND {meta_text('region', '云滩')} ORDER BY seq LIMIT 5)) AS sample FROM questions",
        "delete_remaining": f"SELECT seq, id FROM questions WHERE NOT ({meta_text('region', '云滩')} AND {meta_text('grade', '初')})",
        "chunk_overlap": "WITH c AS (SELECT doc_id, text, unnest(range(0, greatest(0, ceil((length(text) - 2000) / 1600.0))::bigint + 1)) AS chunk_no FROM documents) "
        "SELECT doc_id, chunk_no::int AS chunk_no, length(substr(text, chunk_no * 1600 + 1, 2000))::int AS n, md5(substr(text, chunk_no * 1600 + 1, 2000)) AS chunk_md5 FROM c",
        "clean_text": f"SELECT rec_id, md5({clean('content')}) AS cleaned FROM scanned_records",
        "clean_documents": f"WITH t AS (SELECT doc_id, {clean('text')} AS t FROM documents) SELECT doc_id, length(t)::int AS n, md5(t) AS cleaned FROM t",
        "normalize_text": f"SELECT seq, {normal('content')} AS normal, {question('content')} AS question FROM questions",
        "cjk_space_merge": f"SELECT rec_id, md5({ideographs('content')}) AS joined FROM scanned_records",
        "text_quality_ratio": r"SELECT doc_id, round(len(regexp_extract_all(text, '[A-Za-z0-9\x{4e00}-\x{9fa5}]')) / greatest(length(text), 1), 5) AS ratio FROM documents",
        "scanned_detector": rf"WITH t AS (SELECT doc_hash, coalesce(content, '') AS t FROM scanned_records WHERE page_no BETWEEN 1 AND 3), "
        rf"r AS (SELECT doc_hash, sum(length({trim('t')}))::bigint AS chars, coalesce(avg(len(regexp_extract_all(t, '[A-Za-z0-9\x{{4e00}}-\x{{9fa5}}]')) / length(t)) FILTER (t <> ''), 0) AS ratio, "
        r"bool_or(regexp_matches(t, '\{#\{[^}]*\}#\}')) AS p FROM t GROUP BY 1) SELECT doc_hash, chars, round(ratio, 5) AS ratio, p OR chars < 100 OR ratio < 0.2 AS scanned FROM r",
        "pages_flattened": "WITH p AS (SELECT doc_hash, page_no, string_agg(coalesce(content, ''), chr(10) ORDER BY rec_id) AS c FROM scanned_records GROUP BY 1, 2), "
        "t AS (SELECT doc_hash, string_agg('--- 第 ' || page_no || ' 页 ---' || chr(10) || c, chr(10) ORDER BY page_no) AS t FROM p GROUP BY 1) SELECT doc_hash, length(t)::int AS n, md5(t) AS text_md5 FROM t",
        "question_number_a": f"SELECT seq, {number_record('content')} AS number FROM questions",
        "question_number_b": f"SELECT seq, {number_upload('content')} AS number FROM questions",
        "question_type_heuristic": f"SELECT seq, {kind('content')} AS kind FROM questions",
        "completeness": f"SELECT seq, {complete('content')} AS complete, {sub('content')} AS sub, {kept('content')} AS kept, coalesce(length({trim('content')}) >= 30, false) AND ({complete('content')} OR ({number_record('content')}) IS NOT NULL OR {sub('content')}) AS kept_chunk FROM questions",
        "boilerplate_heuristic": f"WITH l AS (SELECT doc_id, unnest({lines('text')}) AS s FROM documents) SELECT doc_id, count(*) FILTER ({instruction('s')}) AS instructions, count(*) AS lines FROM l GROUP BY 1",
        "lines_head": f"WITH l AS (SELECT doc_id, {lines('text')}[1:30] AS ls FROM documents) SELECT doc_id, (generate_subscripts(ls, 1) - 1)::int AS line_no, unnest(ls) AS line FROM l",
        "meta_year_grade_type_region": META + " SELECT doc_id, year, grade, source_type, region FROM m",
        "title_line_score": TITLED + f" SELECT m.doc_id, {trim(rep(rep('s', f'(?i)[,，]{S}*msu.*$'), f'[{WS}]+', ' '))} AS exam_name, CASE WHEN score >= 2 THEN 0.7 WHEN s IS NOT NULL THEN 0.6 ELSE 0.0 END::double AS confidence FROM m LEFT JOIN b USING (doc_id)",
        "low_confidence": TITLED + f" SELECT m.doc_id, array_to_string(list_filter([{low}], lambda x: x IS NOT NULL), '|') AS fields, region IS NULL OR b.s IS NULL OR year IS NULL OR grade IS NULL AS ask FROM m LEFT JOIN b USING (doc_id)",
        "meta_merge_precedence": f"WITH f AS (SELECT pdf_hash, arg_min(meta_used, import_id) AS m FROM import_history WHERE meta_used IS NOT NULL GROUP BY 1) SELECT seq, {user} FROM questions LEFT JOIN f ON doc_hash = pdf_hash",
        "exam_name_fallback": f"SELECT seq, coalesce(nullif(source_meta.exam_name, ''), nullif({built}, ''), '未命名试卷') AS name FROM questions",
        "question_split": SEGMENTS + " SELECT doc_id, segment_no::int AS segment_no, md5(segment) AS segment_md5 FROM seg",
        "extracted_types": SEGMENTS + f" SELECT {kind('segment')} AS question_type, count(*) AS n, count(DISTINCT doc_id) AS docs FROM seg WHERE NOT {instruction('segment')} AND {kept('segment')} GROUP BY 1",
        "missing_numbers": nums + f", g AS (SELECT DISTINCT doc_id, try_cast({number_upload('segment')} AS bigint) AS number FROM seg) SELECT doc_id, number FROM e WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = e.doc_id AND g.number = e.number)",
        "recovered_numbers": nums + f", g AS (SELECT doc_id, segment_no, segment, try_cast({number_upload('segment')} AS bigint) AS number, {complete('segment')} AS ok FROM seg), "
        "m AS (SELECT doc_id, number FROM e WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = e.doc_id AND g.number = e.number AND g.ok)) "
        "SELECT m.doc_id, m.number, max(g.segment_no)::int AS segment_no, md5(arg_max(g.segment, g.segment_no)) AS segment_md5 FROM m JOIN g ON g.doc_id = m.doc_id AND g.number = m.number GROUP BY 1, 2",
        "provider_extraction": SEGMENTS + f" SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY segment_no)::int AS record_no, md5(segment) AS content_md5, {kind('segment')} AS question_type FROM seg WHERE NOT {instruction('segment')} AND {kept('segment')}",
        "provider_replies": "WITH c AS (SELECT doc_id, text, unnest(range(0, greatest(0, ceil((length(text) - 2000) / 1600.0))::bigint + 1)) AS k FROM documents), "
        "m AS (SELECT doc_id, k, md5(substr(text, k * 1600 + 1, 2000)) AS m FROM c), h AS (SELECT *, ('0x' || m[1])::int % 3 AS kind FROM m), "
        "r AS (SELECT doc_id, k << 32 AS seq, '1. 已知函数f(x)的值为' || m || '，求f(x)' AS content, m FROM h UNION ALL SELECT doc_id, (k << 32) + 1, '2. 若函数f(x)的值为' || m || '，求f(x)', m FROM h WHERE kind = 2) "
        "SELECT doc_id, min(seq) AS seq, content, CASE WHEN any_value(m)[2] < '4' THEN '选择题' ELSE '解答题' END AS question_type, '函数|值' AS points, "
        "CASE WHEN ('0x' || any_value(m)[3])::int % 7 BETWEEN 1 AND 5 THEN ('0x' || any_value(m)[3])::int % 7 ELSE 3 END AS difficulty FROM r GROUP BY doc_id, content",
        "provider_types": f"SELECT seq, CASE md5(substr(content, 1, 500))[1] WHEN '0' THEN '选择题' WHEN '1' THEN '填空题' WHEN '2' THEN '解答题' ELSE {kind('content')} END AS question_type FROM questions WHERE content IS NOT NULL",
        "provider_types_together": f"WITH m AS (SELECT seq, md5({one_line('substr(coalesce(content, {0}), 1, 200)')}) AS m FROM questions) "
        "SELECT seq, CASE WHEN m[1] <= '3' THEN '未知题型' WHEN m[2] < '8' THEN '填空题' ELSE '证明题' END AS question_type FROM m",
        "provider_instructions": f"WITH m AS (SELECT seq, content, md5(substr(content, 1, 300))[1] AS a, md5({one_line('substr(content, 1, 200)')}) AS m FROM questions WHERE content IS NOT NULL) "
        f"SELECT seq, 'kept' AS asked FROM m WHERE NOT CASE a WHEN '0' THEN true WHEN '1' THEN false ELSE {instruction('content')} END UNION ALL SELECT seq, 'kept together' FROM m WHERE NOT (m[1] > '3' AND m[2] < '4')",
        "provider_enrichment": f"WITH n AS (SELECT doc_hash, bool_or(len(coalesce(knowledge_points, [])) = 0 OR coalesce(difficulty, 3) = 3) AS needed FROM questions GROUP BY 1), "
        f"m AS (SELECT seq, knowledge_points, difficulty, needed, md5({one_line('substr(trim(coalesce(content, {0})), 1, 1200)')}) AS m FROM questions q JOIN n ON q.doc_hash IS NOT DISTINCT FROM n.doc_hash) "
        "SELECT seq, CASE WHEN needed AND m[1] > '3' THEN '函数|' || m[3] ELSE coalesce(array_to_string(knowledge_points, '|'), '') END AS points, "
        "CASE WHEN NOT needed OR m[1] <= '3' THEN difficulty WHEN ('0x' || m[4])::int % 8 BETWEEN 1 AND 5 THEN ('0x' || m[4])::int % 8 ELSE 3 END AS difficulty FROM m",
        "provider_metadata": TITLED + ", a AS (SELECT m.*, region IS NULL OR b.s IS NULL OR year IS NULL OR grade IS NULL AS asked, md5(coalesce(substr(d.text, 1, 40), '')) AS k FROM m LEFT JOIN b USING (doc_id) JOIN documents d USING (doc_id)) "
        "SELECT doc_id, CASE WHEN asked AND k[1] < '8' THEN '青坡市' ELSE region END AS region, CASE WHEN asked AND year IS NULL AND k[3] < '8' THEN 2000 + ('0x' || k[2])::int ELSE year END AS year, "
        "CASE WHEN asked AND grade IS NULL THEN '初三' ELSE grade END AS grade, asked FROM a",
        "provider_recovery": nums + f", g AS (SELECT doc_id, try_cast({number_upload('segment')} AS bigint) AS number, {complete('segment')} AS ok FROM seg) "
        "SELECT e.doc_id, e.number, e.number || '. 补回的题目，已知函数f(x)的值，求证：' || md5(d.text) AS content, CASE WHEN e.number % 7 BETWEEN 1 AND 5 THEN e.number % 7 ELSE 3 END::int AS difficulty "
        "FROM e JOIN documents d USING (doc_id) WHERE e.number % 2 = 0 AND NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = e.doc_id AND g.number = e.number AND g.ok)",
        "image_paths": "WITH l AS (SELECT row_id, (generate_subscripts(images, 1) - 1)::int AS at0, unnest(images) AS path FROM assignment_rows), n AS (SELECT *, string_split(path, '/')[-1] AS n FROM l), "
        "f AS (SELECT n, min('/data' || path) AS resolved FROM n WHERE row_id % 2 = 0 GROUP BY 1) SELECT row_id, at0 AS \"at\", path, resolved FROM n LEFT JOIN f USING (n)",
        "merge_by_number": f"WITH b AS (SELECT doc_hash, seq, {trim('content')} AS t FROM incoming_records WHERE doc_hash IS NOT NULL), r AS (SELECT *, {number_record('t')} AS number, {normal('t')} AS f FROM b WHERE t <> ''), "
        "g AS (SELECT doc_hash, number, arg_max(t, (length(t), -seq)) AS bt, arg_max(f, (length(t), -seq)) AS bf, arg_max(seq, (length(t), -seq)) AS bs, min(seq) AS a0 FROM r WHERE number IS NOT NULL GROUP BY 1, 2), "
        "x AS (SELECT g.doc_hash, g.number, string_agg(r.t, chr(10) ORDER BY r.seq) AS e FROM g JOIN r ON g.doc_hash = r.doc_hash AND g.number = r.number WHERE NOT contains(g.bf, r.f) GROUP BY 1, 2), "
        "o AS (SELECT g.doc_hash, g.number, g.bs AS seq, g.a0, g.bt || coalesce(chr(10) || x.e, '') AS content FROM g LEFT JOIN x ON g.doc_hash = x.doc_hash AND g.number = x.number UNION ALL SELECT doc_hash, NULL, seq, seq, t FROM r WHERE number IS NULL) "
        "SELECT doc_hash, number, seq, md5(content) AS content_md5, row_number() OVER (PARTITION BY doc_hash ORDER BY coalesce(try_cast(number AS bigint), 1000000000), number IS NULL, a0)::int AS \"index\" FROM o",
        "kp_coercion": f"SELECT seq, coalesce(array_to_string({points}, '|'), '') AS points FROM questions",
        "difficulty_clamp": "SELECT seq, CASE WHEN difficulty BETWEEN 1 AND 5 THEN difficulty ELSE 3 END AS level, CASE WHEN difficulty BETWEEN 1 AND 5 AND seq % 7 <> 0 THEN difficulty ELSE 3 END AS from_text, "
        "CASE WHEN trunc(difficulty * 0.75::double) BETWEEN 1 AND 5 THEN trunc(difficulty * 0.75::double)::int ELSE 3 END AS from_number FROM questions",
        "enrichment_gate": f"SELECT doc_hash, bool_or(len(list_filter(list_transform(coalesce(knowledge_points, []), lambda s: {trim('s')}), lambda s: s <> '')) = 0 OR CASE WHEN difficulty BETWEEN 1 AND 5 THEN difficulty ELSE 3 END = 3) AS needed FROM questions GROUP BY 1",
        "json_array_parse": "SELECT event_id, CASE event_id % 5 WHEN 3 THEN 0 WHEN 0 THEN 1 ELSE 2 END::int AS n, CASE WHEN event_id % 5 <> 3 THEN (props::json->>'k')::bigint END AS k FROM events",
        "history_page": f"SELECT import_id, pdf_hash, extracted_total, added FROM {latest} ORDER BY import_id DESC LIMIT 50 OFFSET 10",
        "history_lines": "SELECT DISTINCT import_id, pdf_hash, added, meta_used.region AS region FROM import_history WHERE import_id % 5 <> 0",
        "import_totals": f"SELECT pdf_hash, count(*) AS imports, sum(extracted_total)::bigint AS extracted, sum(added)::bigint AS added, sum(duplicates_removed)::bigint AS removed FROM {latest} GROUP BY 1",
        "flat_metadata": "SELECT seq, coalesce(array_to_string(CASE WHEN array_to_string(knowledge_points, ',') = '' THEN [] ELSE string_split(array_to_string(knowledge_points, ','), ',') END, '|'), '') AS points, coalesce(difficulty, 3) AS difficulty, source_meta.region AS region, source_meta.year AS year FROM questions",
        "image_link_rewrite": "WITH i AS (SELECT row_id, unnest(images) AS path FROM assignment_rows), f AS (SELECT string_split(path, '/')[-1] AS n, min('/data' || path) AS resolved FROM i WHERE row_id % 2 = 0 GROUP BY 1) "
        "SELECT row_id, md5(coalesce(content, '') || coalesce((SELECT string_agg(CASE WHEN f.n IS NULL THEN ' ![图' || (x - 1) || '](' || images[x] || ')' ELSE ' <img alt=\"图' || (x - 1) || '\" src=\"' || f.resolved || '\">' END, '' ORDER BY x) "
        "FROM (SELECT unnest(range(1, len(images) + 1)) AS x) u LEFT JOIN f ON f.n = string_split(images[x], '/')[-1]), '')) AS html_md5 FROM assignment_rows WHERE len(images) > 0",
        "assignment_html": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY row_id) AS n FROM assignment_rows), "
        f"s AS (SELECT sheet_id, count(*)::int AS c, string_agg({item}, '' ORDER BY n) AS b FROM r GROUP BY 1) SELECT sheet_id, c AS n, md5('<html><head><meta charset=''utf-8''>{style}</head><body><h1>作业</h1>' || b || '</body></html>') AS html_md5 FROM s",
    }
