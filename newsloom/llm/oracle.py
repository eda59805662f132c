"""DuckDB twins of the registered queries that SQL can express."""

from newsloom.llm import line_quality as q
from newsloom.llm.mixing import FILLS, MAX_EPOCHS, PASSES, SEED

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _count(pattern: str) -> str:
    return f"len(regexp_extract_all(line, {_quoted(pattern)}))"


def _passes() -> str:
    """Twice: the rows after the last border that fit into the words left, as far as these go."""
    return "".join(
        f"""), reach{n} as (
  select u.source, u.lot, any_value(l.rest) as rest,
    sum(sum(u.size)) over (partition by u.source order by u.lot rows unbounded preceding) as upto
  from sized u join left{n} l on u.source is not distinct from l.source
  where u.lot > l.border and u.size <= l.rest group by u.source, u.lot
), border{n} as (
  select source, max(lot) as border, max(upto) as words from reach{n} where upto <= rest group by source
), left{n + 1} as (
  select l.source, l.source_size, l.target, l.whole, l.rest - coalesce(b.words, 0) as rest, coalesce(b.border, l.border) as border
  from left{n} l left join border{n} b on l.source is not distinct from b.source
"""
        for n in range(PASSES)
    )


def _fills() -> str:
    """What is not taken yet, and from it the largest document that fits; at last the one that comes closest."""
    once = " or ".join(
        f"(s.lot > l{n}.border and s.lot <= l{n + 1}.border and s.size <= l{n}.rest)" for n in range(PASSES)
    )
    joins = " ".join(f"join left{n} l{n} on s.source is not distinct from l{n}.source" for n in range(PASSES + 1))
    steps = f"""), open0 as (
  select s.*, l{PASSES}.rest, {once} as once from sized s {joins}
"""
    for n in range(FILLS):
        closest = n == FILLS - 1
        fits, order = ("size < 2 * rest", "abs(size - rest)") if closest else ("size <= rest", "size desc")
        steps += f"""), unit{n} as (
  select source, lot, sum(size)::bigint as size, any_value(rest) as rest from open{n}
  where not once and size > 0 and {fits} group by source, lot
), best{n} as (
  select * from unit{n} where {fits} qualify row_number() over (partition by source order by {order}, lot desc) = 1
), open{n + 1} as (
  select o.doc_id, o.source, o.size, o.lot, o.rest - coalesce(b.size, 0) as rest, o.once or coalesce(o.lot = b.lot, false) as once
  from open{n} o left join best{n} b on o.source is not distinct from b.source
"""
    return steps


# Round n of the pouring: the level with what the rounds before have clamped taken out.
OP4 = f"""
with recursive sized as (
  select doc_id, source, len({WORDS})::bigint as size,
    md5('{SEED}:' || coalesce(doc_id::varchar, text, '')) as lot
  from documents
), totals as (
  select source, sum(size)::bigint as source_size from sized group by source
), ranked as (
  select source, source_size,
    [1, 2, 3][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight
  from totals
), pour(n, level) as (
  select 0, (select sum(source_size) / sum(weight) from ranked)::double
  union all
  select n + 1, (
    select (sum(source_size) - coalesce(sum(source_size * {MAX_EPOCHS}) filter (weight * p.level > source_size * {MAX_EPOCHS}), 0))
      / nullif(sum(weight) - coalesce(sum(weight) filter (weight * p.level > source_size * {MAX_EPOCHS}), 0), 0)
    from ranked)::double
  from pour p where n < (select count(*) from ranked) and level is not null
), settled as (
  select max(level) as level from pour
), filled as (
  select source, source_size, least(weight * level, source_size * {MAX_EPOCHS})::double as target from ranked, settled
), quotas as (
  select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as whole from filled
), left0 as (
  select *, target - whole * source_size as rest, '' as border from quotas
{_passes()}
{_fills()}
)
select s.doc_id, s.size, q.source_size, q.target, (s.size * (q.whole + s.once::int))::bigint as taken
from open{FILLS} s join quotas q on s.source is not distinct from q.source
"""

OP5 = f"""
with base as (
  select row_number() over () as r, doc_id, coalesce(text, '') as text, {WORDS} as w from documents
), lined as (
  select r, unnest(string_split(text, chr(10))) as raw from base
), lines as (
  select r, raw, regexp_replace(raw, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') as line from lined
), judged as (
  select r, raw, len(regexp_extract_all(raw, '[^\\x20\\x09-\\x0D]+')) as n,
    not regexp_matches(line, {_quoted(q.SENTENCE_END)})
    or {_count(q.SYMBOLS)} * {q.SYMBOL_SHARE} > length(line)
    or {_count(q.SHOUT)} >= {q.MIN_SHOUTS}
    or (not regexp_matches(line, {_quoted(q.LOWER)}) and {_count(q.CAPITAL)} >= {q.MIN_CAPITALS})
    or {_count(q.SEPARATOR)} >= {q.MIN_SEPARATORS}
    or (length(line) <= {q.BOILERPLATE_CHARS} and regexp_matches(line, {_quoted(q.BOILERPLATE)})) as fails
  from lines where line <> ''
), per_line as (
  select r, (count(*) - count(distinct raw))::bigint as n_dup_lines,
    coalesce(sum(n) filter (fails), 0)::bigint as n_lost_words
  from judged group by r
), placed as (
  select r, unnest(w) as word, unnest(range(len(w)))::bigint as i from base
), starts as (
  select r, i, word, {", ".join(f"lead(word, {k}) over (partition by r order by i) as w{k}" for k in range(1, q.WINDOW))}
  from placed
), windows as (
  select r, i, count(*) over (partition by r, word, {", ".join(f"w{k}" for k in range(1, q.WINDOW))}) as times
  from starts where w{q.WINDOW - 1} is not null
), twice as (
  select r, i, lead(i) over (partition by r order by i) as next from windows where times > 1
), repeated as (
  select r, sum(least({q.WINDOW}, coalesce(next - i, {q.WINDOW})))::bigint as n_repeat_words from twice group by r
), counted as (
  select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
    len(regexp_extract_all(text, {_quoted(q.SYMBOLS)}))::bigint as n_symbols,
    coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
    coalesce(n_lost_words, 0) as n_lost_words
  from base left join per_line using (r) left join repeated using (r)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < {q.MIN_WORDS} or 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words) as base_failed, n_lost_words,
  not (n_words < {q.MIN_WORDS} or 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words)
    and 100 * n_lost_words <= {q.MAX_LOST_PERCENT} * n_words as kept
from counted
"""

OP9 = r"""
with base as (
  select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents
), keyed as (
  select r, unnest(lines) as line, unnest(range(len(lines))) as i from base
), keys as (
  select r, i, line, translate(
    regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from keyed
), common as (
  select key from keys where length(key) >= 1 group by key having count(distinct r) >= 10
), kept as (
  select r, count(*)::bigint as n_lines, count(c.key)::bigint as n_dropped,
    coalesce(string_agg(line, chr(10) order by i) filter (c.key is null), '') as text
  from keys left join common c using (key) group by r
)
select doc_id, n_lines, n_dropped, sha256(text) as kept_sha256 from base join kept using (r)
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP11 = f"""
with docs as (
  select row_number() over () as r, doc_id, {_TERMS} as terms from documents
), counted as (
  select r, doc_id, len(terms)::bigint as n, terms from docs where len(terms) > 0
), totals as (
  select count(*)::bigint as rows, sum(n)::bigint as words from counted
), postings as (
  select r, term, count(*)::bigint as tf from (select r, unnest(terms) as term from counted) group by r, term
), weights as (
  select term, floor(1000 * ln((2 * max(rows) + 2)::double / (2 * count(*) + 1)::double))::bigint as w
  from postings, totals group by term
), asked as (
  select i, item_id, term, count(*)::bigint as repeats
  from (select row_number() over () as i, item_id, unnest({_TERMS}) as term from benchmark) group by i, item_id, term
), scored as (
  select a.i, a.item_id, p.r, sum(
    a.repeats * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (25 + (75 * c.n * t.rows) // t.words)))
  )::bigint as score
  from asked a join postings p using (term) join weights w using (term) join counted c on c.r = p.r, totals t
  group by a.i, a.item_id, p.r
), ranked as (
  select i, item_id, c.doc_id, score,
    row_number() over (partition by i order by score desc, c.doc_id nulls last)::int as rank
  from scored s join counted c on c.r = s.r where score > 0
)
select item_id, rank, doc_id, score from ranked where rank <= 10
"""

OP12 = """
with usable as (
  select distinct vec_id, embedding::double[] as v from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and list_aggregate(list_transform(embedding, lambda x: (x is not null and isfinite(x))::int), 'min') = 1
    and list_aggregate(list_transform(embedding, lambda x: (x <> 0)::int), 'max') = 1
), pairs as (
  select distinct q.vec_id as query_id, c.vec_id, list_cosine_similarity(q.v, c.v) as score
  from usable q join usable c on c.vec_id <> q.vec_id and len(c.v) = len(q.v) where q.vec_id % 50 = 0
), ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from pairs
)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""

OP13 = rf"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) as piece from documents
), split as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces
), sizes as (
  select lang, sum(len(w))::bigint as n from split group by lang
), spans as (
  select lang, w, k, unnest(range(1, len(w) - k + 2)) as i
  from (select lang, w, unnest([1, 2, 3, 4]) as k from split) where len(w) >= k
), counts as (
  select lang, k, w[i:i + k - 1] as words, count(*)::bigint as f from spans group by all
), candidates as (
  select * from counts where k > 1 and f >= 30
), cuts as (
  select lang, words, f as a, unnest(range(1, k)) as cut from candidates
), scored as (
  select c.lang, c.words, c.a, c.cut, x.f as l, y.f as r, ((2000000 * c.a::hugeint) // (x.f + y.f))::bigint as score
  from cuts c
  join counts x on x.lang = c.lang and x.words = c.words[1:c.cut]
  join counts y on y.lang = c.lang and y.words = c.words[c.cut + 1:]
), weakest as (
  select *, row_number() over (partition by lang, words order by score, cut) as place from scored
), parts as (
  select lang, f, words, k, size, unnest(range(1, k - size + 2)) as i
  from (select lang, f, words, k, unnest(range(2, k)) as size from candidates where k > 2)
), most as (
  select lang, words[i:i + size - 1] as words, max(f) as f from parts group by all
), kept as (
  select w.lang, array_to_string(w.words, ' ') as phrase, w.a, w.l, w.r, w.score
  from weakest w left join most m on m.lang = w.lang and m.words = w.words
  where w.place = 1 and not coalesce(100 * m.f >= 80 * w.a, false)
), ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase)::int as rank from kept
)
select lang, rank, phrase, a, l, r, n, score from ranked join sizes using (lang) where rank <= 2000
"""
