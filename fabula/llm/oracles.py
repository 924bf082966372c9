"""DuckDB SQL for the operators that SQL can express on whole tables."""

_AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = rf"""with dw as (select doc_id, regexp_extract_all({_AZ}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from documents),
iw as (select item_id, ws, least(10, len(ws)) n from (select item_id, regexp_extract_all({_AZ}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from benchmark) where len(ws) > 0),
item as (select distinct item_id, n, array_to_string(ws[i:i + n - 1], ' ') k from (select item_id, ws, n, unnest(range(1, len(ws) - n + 2)) i from iw)),
doc as (select doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') k from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) i from dw, (select distinct n from iw))),
met as (select doc_id, i, n, item_id from doc join item using (n, k)),
hit as (select doc_id, count(*) n_hit from (select distinct doc_id, unnest(range(i, i + n)) p from (select distinct doc_id, i, n from met)) group by 1),
own as (select doc_id, count(*) n_items, string_agg(id, ',' order by id) ids from (select distinct doc_id, cast(item_id as varchar) id from met) group by 1)
select doc_id, cast(len(ws) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from dw left join hit using (doc_id) left join own using (doc_id)"""

OP6 = """with t as (select doc_id, hex(encode(coalesce(text, ''))) h from documents),
w as (select doc_id, i, md5_number(substr(h, cast(2 * i + 1 as int), 200)) k from (select doc_id, h, unnest(range(0, length(h) // 2 - 99)) i from t)),
f as (select k, arg_min(doc_id, (doc_id, i)) d, arg_min(i, (doc_id, i)) s from w group by k),
g as (select doc_id, i from w join f using (k) where doc_id <> d or i <> s),
p as (select doc_id, i, case when i <= max(i) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding) + 100 then 0 else 1 end new_span from g),
r as (select doc_id, span, min(i) s, max(i) + 100 e from (select doc_id, i, sum(new_span) over (partition by doc_id order by i) span from p) group by all),
x as (select doc_id, span, s, lag(e, 1, 0) over (partition by doc_id order by s) prev, e from r),
k as (select doc_id, sum(e - s) n_removed, count(*) n_spans, max(e) last, string_agg(substr(h, cast(2 * prev + 1 as int), cast(2 * (s - prev) as int)), '' order by s) head from x join t using (doc_id) group by doc_id)
select doc_id, cast(length(h) // 2 as bigint) n_bytes, cast(coalesce(n_removed, 0) as bigint) n_removed, coalesce(n_spans, 0) n_spans, sha256(unhex(coalesce(head, '') || substr(h, cast(2 * coalesce(last, 0) + 1 as int)))) kept_sha256
from t left join k using (doc_id)"""

OP7 = """with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) v from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select q.vec_id query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) score from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id)
select query_id, place as rank, vec_id, score from (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) place from p) where place <= 5"""

OP9 = rf"""with recursive w as (select doc_id, regexp_extract_all({_AZ}, '[^\x20\x09-\x0D]+') ws from documents),
sh as (select distinct doc_id, ws[i] || ' ' || ws[i + 1] s from (select doc_id, ws, unnest(range(1, len(ws))) i from w where len(ws) > 1) union all select doc_id, ws[1] from w where len(ws) = 1),
n as (select doc_id, count(*) n from sh group by 1),
both_ as (select a.doc_id a, b.doc_id b, count(*) c from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by all),
link as (select a, b from both_ join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
edge as (select a, b from link union all select b, a from link),
reach(id, seen) as (select doc_id, doc_id from w union select b, seen from reach join edge on id = a)
select w.doc_id, coalesce(n, 0) n_shingles, c component_id, c = w.doc_id kept from w left join n on n.doc_id = w.doc_id join (select id, min(seen) c from reach group by 1) r on r.id = w.doc_id"""

OP10 = r"""with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from documents),
win as (select doc_id, i, array_to_string(ws[i:i + 12], ' ') k from (select doc_id, ws, unnest(range(1, len(ws) - 11)) i from w)),
f as (select k, min(doc_id) d from win group by k),
g as (select distinct doc_id, unnest(range(i, i + 13)) p from win join f using (k) where d < doc_id),
x as (select doc_id, unnest(range(1, len(ws) + 1)) p, unnest(ws) word from w),
k as (select x.doc_id, count(g.p) n_removed, string_agg(word, ' ' order by x.p) filter (where g.p is null) kept from x left join g on g.doc_id = x.doc_id and g.p = x.p group by 1)
select doc_id, cast(len(ws) as bigint) n_words, coalesce(n_removed, 0) n_removed, sha256(coalesce(kept, '')) kept_sha256 from w left join k using (doc_id)"""

OP11 = r"""with t as (select doc_id, length(coalesce(text, '')) n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) text_sha256 from documents)
select doc_id, first_value(doc_id) over w keep_id, count(*) over w group_size, doc_id = first_value(doc_id) over w kept, text_sha256 from t
window w as (partition by text_sha256 order by n desc, doc_id rows between unbounded preceding and unbounded following)"""

OP12 = """with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end l, list_transform(embedding, lambda x: floor(256 * x::double)) v from embeddings
 where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id a, b.vec_id b, a.l = b.l same, cast(list_inner_product(a.v, b.v) as bigint) score from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
p as (select a, b, score from (select *, row_number() over (partition by a order by score desc, b) place from s where same) where place <= 5),
n as (select p.a, p.b, s.b c, p.score ps, s.score ns, row_number() over (partition by p.a, p.b order by s.score desc, s.b) place from p join s on p.a = s.a and not s.same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score)
select a anchor_id, b positive_id, cast(place as int) as rank, c negative_id, ps positive_score, ns negative_score from n where place <= 3"""


def _op13(rounds: int = 3) -> str:
    """Rounds of assignment (r) and of new centroids (c), one after the other."""
    steps = [
        "v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) v from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        "c0 as (select cast(row_number() over (order by sha256('1:' || vec_id)) - 1 as int) c, v from v qualify c < 16)",
    ]
    for i in range(rounds + 1):
        steps.append(f"r{i} as (select vec_id, arg_min(c, (d, c)) c, min(d) d from (select vec_id, c, list_sum(list_transform(list_zip(v.v, c{i}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) d from v, c{i}) group by 1)")
        means = f"select c, list(m order by i) v from (select c, i, floor(sum(x) / count(*)) m from (select c, unnest(v) x, unnest(range(64)) i from r{i} join v using (vec_id)) group by 1, 2) group by 1"
        steps.append(f"c{i + 1} as (select c, coalesce(n.v, c{i}.v) v from c{i} left join ({means}) n using (c))")
    last = f"r{rounds} join c{rounds} using (c)"
    out = "select vec_id, c as cluster, cast(d as bigint) distance, cast(sum(d) over (partition by c) as bigint) cluster_inertia, cast(sum(d) over () as bigint) inertia, sha256(array_to_string(list_transform(v, lambda x: cast(x as bigint)), ',')) centroid_sha256"
    return f"with {', '.join(steps)} {out} from {last}"


OP13 = _op13()
