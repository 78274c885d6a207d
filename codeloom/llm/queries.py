"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import format_pairs, swapped_endings
from ..session import scratch_folder
from .codes import code_vectors, with_label_error
from .common import read_table
from .decontaminate import find_leaks
from .language import fit, predict
from .lines import dedup_lines
from .lm_score import labelled_good, score_documents
from .packing import pack, token_pieces
from .phrases import best_phrases, find_phrases
from .quality import quality_rules
from .simhash import near_duplicates
from .substrings import dedup_substrings
from .token_files import read_token_files, with_crc, write_token_files
from .urls import filter_urls


#: The tokenizer of the queries.
TOKENIZER = "word_bpe_49k.json"


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in sequences of at most 4096 tokens."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = token_pieces(docs, public_tokenizers.path(TOKENIZER), end_id=1, capacity=4096)
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(digests, 4096)


def op2_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against itself with its neighbour's ending."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    pairs = format_pairs(swapped_endings(turns)).withColumnRenamed("pair_id", "conv_id")
    shown = [F.expr(f"array_join(transform({c}_spans, s -> concat(s.start, '+', s.length)), ',')").alias(f"{c}_spans") for c in ("chosen", "rejected")]
    return pairs.select("conv_id", "n_prompt_turns", "prompt", "chosen", "rejected", *shown)


# The rules of the query.
URL_RULES = """
  ('com', '/', 'allow'),
  ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'),
  ('net', '/fr/', 'block')
"""


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.sql(f"select * from values {URL_RULES} as rules(host, path, verdict)")
    return filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict for every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality_rules(docs)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaked benchmark items of every document that has any."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = find_leaks(docs, read_table(spark, sf_dir, "benchmark"))
    found = marked.select("doc_id", F.explode("leaks").alias("leak"))
    return found.select("doc_id", F.col("leak.item_id").alias("item_id"), F.col("leak.similarity").alias("similarity"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the 13-word windows of earlier documents."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = dedup_substrings(docs, window=13)
    kept = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(kept, 256).alias("kept_sha256"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as token ids in ORC files, read back."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    path = scratch_folder(spark, "token-files")
    write_token_files(docs, path, public_tokenizers.path(TOKENIZER), end_id=2)
    return with_crc(read_token_files(spark, path))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of every document: labelled good against all."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, labelled_good(read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "n_tokens", *[F.round(c, 6).alias(c) for c in ("loss_target", "loss_background", "score")])


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of 3-word shingles and components at two bits."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = near_duplicates(docs, words=3, columns=["doc_id"])
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the documents that aren't
    held out."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = fit(docs.filter(~held).filter("doc_id is not null"))
    found = predict(docs.select("doc_id", "text", held.alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that three of them have."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = dedup_lines(docs, min_chars=20, min_docs=3)
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language."""
    docs = read_table(spark, sf_dir, "documents").select("lang", "text")
    return best_phrases(find_phrases(docs, least=100, longest=5)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings' codes, and the errors of each label."""
    coded = code_vectors(read_table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4)
    return with_label_error(coded.rows).select("vec_id", "code", "error", "label_error", F.lit(coded.sha256).alias("codebooks_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_preferences": op2_preferences,
    "op3_url_filter": op3_url_filter,
    "op4_quality_rules": op4_quality_rules,
    "op5_decontamination": op5_decontamination,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_token_files": op7_token_files,
    "op8_lm_score": op8_lm_score,
    "op9_simhash": op9_simhash,
    "op10_language_id": op10_language_id,
    "op11_line_dedup": op11_line_dedup,
    "op12_phrases": op12_phrases,
    "op13_vector_codes": op13_vector_codes,
}
SQL: dict[str, str] = {
    "op6_substring_dedup": r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from documents),
win as (select doc_id, i, array_to_string(ws[i:i + 12], ' ') s from (select doc_id, ws, unnest(range(1, len(ws) - 11)) i from d)),
least as (select s, min(doc_id) m from win group by s),
gone as (select distinct doc_id, j from (select doc_id, unnest(range(i, i + 13)) j from win join least on win.s = least.s where m < doc_id)),
w as (select doc_id, unnest(range(1, len(ws) + 1)) j, unnest(ws) x from d),
k as (select w.doc_id, string_agg(x, ' ' order by w.j) t from w left join gone on gone.doc_id = w.doc_id and gone.j = w.j where gone.j is null group by w.doc_id),
g as (select doc_id, count(*) n from gone group by doc_id)
select d.doc_id, cast(len(ws) as bigint) n_words, coalesce(g.n, 0) n_removed, sha256(coalesce(k.t, '')) kept_sha256
from d left join k on k.doc_id = d.doc_id left join g on g.doc_id = d.doc_id
""",
    "op2_preferences": r"""
with t as (
  select conv_id, turn, replace(coalesce(role, ''), '<|im_', '<|im _') as role, replace(coalesce(text, ''), '<|im_', '<|im _') as text from conversations where conv_id is not null
), last as (
  select conv_id, max(struct_pack(turn := turn, text := text)) l from t where role = 'assistant' group by conv_id
), rej as (
  select t.conv_id, t.turn, t.role,
    case when t.role = 'assistant' and t.turn = o.l.turn and t.text = o.l.text then n.l.text else t.text end as text
  from t left join last o on o.conv_id = t.conv_id left join last n on n.conv_id = xor(t.conv_id, 1)
  where not coalesce(t.role = 'assistant' and t.turn = o.l.turn and t.text = o.l.text, false) or n.l.text is not null
), c as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) i from t),
r as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) i from rej),
n as (
  select k.conv_id, least(coalesce(min(j.i) filter (where not j.eq), 1000000000), max(j.i) + 1) - 1 as n
  from (select distinct conv_id from c) k
  join (
    select coalesce(c.conv_id, r.conv_id) conv_id, coalesce(c.i, r.i) i, coalesce(c.role = r.role and c.text = r.text, false) eq
    from c full join r on c.conv_id = r.conv_id and c.i = r.i
  ) j on j.conv_id = k.conv_id
  group by k.conv_id
), w as (
  select 'c' side, * from c union all select 'r' side, * from r
), z as (
  select side, w.conv_id, i, role, i <= n.n as common, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) as s,
    length(role) + 13 as head, length(text) + 11 as body
  from w join n on n.conv_id = w.conv_id
), o as (
  select *, coalesce(sum(head + body) over (partition by side, conv_id, common order by i rows between unbounded preceding and 1 preceding), 0) as before from z
)
select n.conv_id, cast(n.n as integer) n_prompt_turns,
  coalesce(string_agg(s, '' order by i) filter (where side = 'c' and common), '') prompt,
  coalesce(string_agg(s, '' order by i) filter (where side = 'c' and not common), '') chosen,
  coalesce(string_agg(s, '' order by i) filter (where side = 'r' and not common), '') rejected,
  coalesce(string_agg(cast(before + head as bigint) || '+' || body, ',' order by i) filter (where side = 'c' and not common and role = 'assistant'), '') chosen_spans,
  coalesce(string_agg(cast(before + head as bigint) || '+' || body, ',' order by i) filter (where side = 'r' and not common and role = 'assistant'), '') rejected_spans
from n left join o on o.conv_id = n.conv_id
group by n.conv_id, n.n
""",
    "op8_lm_score": r"""
with good as (select distinct doc_id from labels where quality = 1 and doc_id is not null),
d as (select doc_id, doc_id in (select doc_id from good) is_target, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws from documents),
w as (select doc_id, is_target, i, ws[i] w, case when i > 1 then ws[i - 1] end v from (select *, unnest(range(1, len(ws) + 1)) i from d)),
one as (select w, count(*) b, count(*) filter (where is_target) t from w group by 1),
two as (select v, w, count(*) b, count(*) filter (where is_target) t from w where v is not null group by 1, 2),
mine1 as (select doc_id, w, count(*) n from w group by 1, 2),
mine2 as (select doc_id, v, w, count(*) n from w where v is not null group by 1, 2, 3),
size as (select count(*) b, count(*) filter (where is_target) t, (select count(*) from one) vocabulary from w),
c as (
  select w.doc_id, len(d.ws) len, vocabulary,
    one.b - m1.n b1, one.t - if(w.is_target, m1.n, 0) t1, size.b - len(d.ws) nb, size.t - if(w.is_target, len(d.ws), 0) nt,
    before.b - mb.n bv, before.t - if(w.is_target, mb.n, 0) tv, two.b - m2.n b2, two.t - if(w.is_target, m2.n, 0) t2
  from w join d on d.doc_id = w.doc_id cross join size
  join one on one.w = w.w join mine1 m1 on m1.doc_id = w.doc_id and m1.w = w.w
  left join one before on before.w = w.v left join mine1 mb on mb.doc_id = w.doc_id and mb.w = w.v
  left join two on two.v = w.v and two.w = w.w left join mine2 m2 on m2.doc_id = w.doc_id and m2.v = w.v and m2.w = w.w
), p as (
  select doc_id, len,
    case when bv > 0 then 0.6::double * b2 / bv + 0.35::double * b1 / greatest(nb, 1) else 0.95::double * b1 / greatest(nb, 1) end + 0.05::double / vocabulary pb,
    case when tv > 0 then 0.6::double * t2 / tv + 0.35::double * t1 / greatest(nt, 1) else 0.95::double * t1 / greatest(nt, 1) end + 0.05::double / vocabulary pt
  from c
), s as (select doc_id, sum(-ln(pt)) / max(len) lt, sum(-ln(pb)) / max(len) lb from p group by 1)
select d.doc_id, cast(len(ws) as bigint) n_tokens, round(lt, 6) loss_target, round(lb, 6) loss_background, round(lt - lb, 6) score
from d left join s on s.doc_id = d.doc_id
""",
    "op3_url_filter": r"""
with u as (
  select page_id, coalesce(case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) end, '') rest from pages
), p as (
  select page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path
  from u
), r(h, q, v) as (values """ + URL_RULES + r"""), m as (
  select page_id, host, path, max(struct_pack(n := length(h || q), rule := h || q, v := v)) best
  from p left join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, q)
  group by page_id, host, path
)
select page_id, host, path, best.rule as rule, coalesce(best.v, 'allow') as verdict from m
""",
    "op4_quality_rules": r"""
with d as (select doc_id, coalesce(text, '') t from documents),
w as (select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') ws from d),
win as (
  select doc_id, i, unnest([5, 8, 101]) k, ws from (select doc_id, ws, unnest(range(1, len(ws) + 1)) i from w)
), full_win as (
  select doc_id, k, i, hash(array_to_string(ws[i:i + k - 1], ' ')) h, array_to_string(ws[i:i + k - 1], ' ') s from win where i + k - 1 <= len(ws)
), found as (
  select doc_id, k, i from (select doc_id, k, i, count(*) over (partition by doc_id, k, h, s) n from full_win) where n > 1
), covered as (
  select doc_id, k, count(distinct j) n from (select doc_id, k, unnest(range(i, i + k)) j from found) group by doc_id, k
), lines as (
  select doc_id, l, count(*) n from (select doc_id, unnest(string_split(t, chr(10))) l from d) where regexp_matches(l, '[^\x20\x09-\x0D]') group by doc_id, l
), dup as (select doc_id, sum(n - 1) n from lines group by doc_id),
m as (
  select doc_id, len(ws) n_words, coalesce(length(array_to_string(ws, '')), 0) word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) n_symbols,
    coalesce((select n from dup where dup.doc_id = w.doc_id), 0) n_dup_lines,
    coalesce((select n from covered c where c.doc_id = w.doc_id and k = 8), 0) n_repeat_words,
    coalesce((select n from covered c where c.doc_id = w.doc_id and k = 5), 0) covered_words,
    exists (select 1 from covered c where c.doc_id = w.doc_id and k = 101) too_long
  from w
)
select doc_id, cast(n_words as bigint) n_words, cast(word_chars as bigint) word_chars, cast(n_symbols as bigint) n_symbols,
  cast(n_dup_lines as bigint) n_dup_lines, cast(n_repeat_words as bigint) n_repeat_words,
  n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and 10 * covered_words <= 4 * n_words and not too_long as kept,
  cast(covered_words as bigint) covered_words
from m
""",
    "op11_line_dedup": r"""
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) i from documents
), k as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') k from l
), often as (
  select k, max(doc_id) last from k where length(k) >= 20 group by k having count(distinct doc_id) >= 3
), m as (
  select k.*, often.k is not null and doc_id <> last gone from k left join often on often.k = k.k
)
select doc_id, count(*) n_lines, count(*) filter (where gone) n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) kept_sha256
from m group by doc_id
""",
    "op12_phrases": r"""
with p as (
  select coalesce(lang, 'und') lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) piece from documents
), w as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') ws from p),
g as (select lang, k, array_to_string(ws[i:i + k - 1], ' ') phrase from (select lang, ws, unnest(range(1, len(ws) + 1)) i from w), unnest([1, 2, 3, 4, 5]) t(k) where i + k - 1 <= len(ws)),
f as materialized (select lang, k, phrase, count(*) a from g group by lang, k, phrase having count(*) >= 100),
size as (select lang, count(*) n from g where k = 1 group by lang),
c as materialized (select lang, k, phrase, a, string_split(phrase, ' ') ws from f where k > 1),
gone as (
  select distinct s.lang, s.phrase from c s join (
    select lang, k, a, array_to_string(ws[i:i + m - 1], ' ') part from (select *, unnest(range(1, k + 1)) i from c), unnest([2, 3, 4]) t(m) where m < k and i + m - 1 <= k
  ) q on q.lang = s.lang and q.part = s.phrase and 100 * q.a >= 100 * s.a
),
cut as (select lang, k, phrase, a, i, array_to_string(ws[1:i], ' ') x, array_to_string(ws[i + 1:k], ' ') y from (select *, unnest(range(1, k)) i from c)),
scored as (
  select cut.lang, cut.phrase, cut.a, i, x.a l, y.a r, n, (1000::hugeint * cut.a * n) // (x.a::hugeint * y.a) score
  from cut join f x on x.lang = cut.lang and x.phrase = cut.x join f y on y.lang = cut.lang and y.phrase = cut.y join size on size.lang = cut.lang
),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, i) = 1),
ranked as (select best.*, row_number() over (partition by best.lang order by score desc, a desc, best.phrase) as rank from best left join gone on gone.lang = best.lang and gone.phrase = best.phrase where gone.phrase is null)
select lang, cast(rank as bigint) as rank, phrase, a, l, r, n, cast(score as bigint) score from ranked where rank <= 2000
""",
}


def _code_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """The rounds of op13 one after the other."""
    steps = [f"""
with e as materialized (select vec_id, label, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
x as materialized (select vec_id, i, (i - 1) // (len(v) // {parts}) p, v[i] x from (select vec_id, v, unnest(range(1, len(v) + 1)) i from e)),
c0 as materialized (select dense_rank() over (order by vec_id) - 1 entry, p, i, x c from x where vec_id in (select vec_id from e order by vec_id limit {entries}))"""]
    for k in range(rounds + 1):
        steps.append(f"""d{k} as materialized (select vec_id, x.p, entry, sum((x - c) * (x - c)) far from x join c{k} using (i) group by vec_id, x.p, entry),
a{k} as materialized (select vec_id, p, arg_min(entry, (far, entry)) entry, min(far) far from d{k} group by vec_id, p)""")
        if k < rounds:
            steps.append(f"""s{k} as (select a{k}.entry, i, cast(sum(x) as bigint) s, count(*) n from x join a{k} using (vec_id, p) group by a{k}.entry, i),
c{k + 1} as materialized (select c{k}.entry, p, i, case when n is null then c else (s - ((s % n) + n) % n) // n end c from c{k} left join s{k} using (entry, i))""")
    return ",\n".join(steps) + f""",
f as (select vec_id, string_agg(printf('%02x', entry), '' order by p) code, cast(sum(far) as bigint) error from a{rounds} group by vec_id),
l as (select label, cast(sum(error) as bigint) label_error from e join f using (vec_id) group by label),
h as (select sha256(string_agg(cast(c as varchar), ',' order by p, entry, i)) codebooks_sha256 from c{rounds})
select e.vec_id, code, error, label_error, codebooks_sha256 from e join f using (vec_id) join l on l.label is not distinct from e.label cross join h
"""


SQL["op13_vector_codes"] = _code_sql()
