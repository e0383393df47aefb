"""SQL (DuckDB) for the results that SQL can express at test sizes."""

from ballast.llm.sharding import round_keys

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

PHRASES = f"""with d as (select doc_id, {WORDS} as w from documents),
 win as (select doc_id, unnest(range(1, len(w)-33)) as i, w from d where len(w)>=35),
 seq as (select doc_id, i, array_to_string(w[i:i+34], ' ') as s from win),
 twice as (select s from seq group by s having count(*)>1),
 gone as (select distinct doc_id, unnest(range(i, i+35)) as p from seq semi join twice on twice.s=seq.s),
 word as (select doc_id, unnest(range(1, len(w)+1)) as p, unnest(w) as x from d),
 kept as (select word.doc_id, string_agg(x, ' ' order by word.p) as t, count(*) as n from word anti join gone on gone.doc_id=word.doc_id and gone.p=word.p group by word.doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, cast(len(w)-coalesce(n, 0) as bigint) n_removed, sha256(coalesce(t, '')) kept_sha256 from d left join kept on kept.doc_id=d.doc_id"""

NEAR = f"""with recursive d as (select doc_id, {WORDS.replace("coalesce(text, '')", LOWER)} as w from documents),
 s as (select doc_id, case when len(w)>1 then list_distinct(list_transform(range(1, len(w)), lambda i: w[i]||' '||w[i+1])) else w end as g from d),
 e as (select doc_id, len(g) as n, unnest(g) as x from s),
 met as (select a.doc_id a, b.doc_id b, a.n na, b.n nb, count(*) k from e a join e b on a.x=b.x and a.doc_id<b.doc_id group by all),
 near as (select a, b from met where 100*k>=80*(na+nb-k)),
 sides as (select a, b from near union select b, a from near),
 r(v, c) as (select doc_id, doc_id from s union select sides.b, r.c from r join sides on sides.a=r.v),
 least_ as (select v, min(c) c from r group by v)
select s.doc_id, cast(len(g) as bigint) n_shingles, c component_id, c=s.doc_id kept from s join least_ on least_.v=s.doc_id"""

VECTORS = """with recursive v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings),
 ok as (select * from v where len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x)))=0 and len(list_filter(e, lambda x: x<>0))>0),
 near as (select a.vec_id a, b.vec_id b from ok a join ok b on a.vec_id<>b.vec_id and len(a.e)=len(b.e) where list_cosine_similarity(a.e, b.e)>=0.9),
 r(v, c) as (select vec_id, vec_id from v union select near.b, r.c from r join near on near.a=r.v),
 least_ as (select v, min(c) c from r group by v), degree as (select a, count(*) n from near group by a)
select vec_id, coalesce(n, 0) n_links, c component_id, c=vec_id kept from v join least_ on least_.v=vec_id left join degree on degree.a=vec_id"""

BYTES = """with d as (select doc_id, encode(coalesce(text, '')) as b from documents),
 h as (select doc_id, hex(b) as x, octet_length(b) as n from d),
 win as (select doc_id, unnest(range(1, n-198)) as i, x from h where n>=200),
 seq as (select doc_id, i, md5(substring(x, 2*i-1, 400)) as s from win),
 twice as (select s from seq group by s having count(*)>1),
 hit as (select doc_id, i, i-lag(i) over (partition by doc_id order by i) as step from seq semi join twice on twice.s=seq.s),
 run as (select doc_id, i, sum(case when step<=200 then 0 else 1 end) over (partition by doc_id order by i) as no from hit),
 span as (select doc_id, no, min(i) as a, max(i)+199 as z from run group by all),
 gap as (select doc_id, a, z, lag(z, 1, 0) over (partition by doc_id order by a) as before from span),
 part as (select g.doc_id, g.a, substring(x, 2*before+1, 2*(g.a-before-1)) as t from gap g join h on h.doc_id=g.doc_id
   union all select h.doc_id, 1000000000, substring(x, 2*coalesce(last, 0)+1) from h left join (select doc_id, max(z) as last from span group by doc_id) l on l.doc_id=h.doc_id),
 kept as (select doc_id, string_agg(t, '' order by a) as t from part group by doc_id),
 gone as (select doc_id, sum(z-a+1) as r, count(*) as k from span group by doc_id)
select h.doc_id, cast(n as bigint) n_bytes, cast(coalesce(r, 0) as bigint) n_removed, cast(coalesce(k, 0) as bigint) n_spans, sha256(unhex(t)) kept_sha256
from h join kept on kept.doc_id=h.doc_id left join gone on gone.doc_id=h.doc_id"""

# Whole-number k-means: a vector meets all centroids, the least distance (then number) wins; means are floored.
_ROUND = """ a{r} as (select vec_id, rid, q, k, d from (select v.*, c{r}.k, list_sum(list_transform(list_zip(v.q, c{r}.q), lambda p: (p[1]-p[2])*(p[1]-p[2])))::bigint d from v cross join c{r}) qualify row_number() over (partition by rid order by d, k)=1)"""
_MOVE = """ s{r} as (select k, i, sum(q[i]) s, count(*) n from a{r}, unnest(range(1, 65)) u(i) group by k, i), c{n} as (select c{r}.k, coalesce(m.q, c{r}.q) q from c{r} left join (select k, list(cast((s-((s%n)+n)%n)//n as bigint) order by i) q from s{r} group by k) m on m.k=c{r}.k)"""
CENTROIDS = (
    """with v as (select vec_id, row_number() over () rid, list_transform(embedding, lambda x: cast(floor(64*x::double) as bigint)) q from embeddings
 where embedding is not null and len(embedding)=64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x)))=0),
 c0 as (select row_number() over (order by sha256('1:'||vec_id), q)-1 k, q from v where vec_id is not null qualify k<16),"""
    + ",".join(_ROUND.format(r=r) + "," + _MOVE.format(r=r, n=r + 1) for r in range(3))
    + ","
    + _ROUND.format(r=3)
    + """ select a3.vec_id, cast(a3.k as int) "cluster", d distance, cast(sum(d) over (partition by a3.k) as bigint) cluster_inertia, cast(sum(d) over () as bigint) inertia, sha256(array_to_string(c3.q, ',')) centroid_sha256 from a3 join c3 on c3.k=a3.k"""
)

# CRC-32 byte by byte, with the table of its polynomial.
_CRC_TABLE = """tb as (select list(list_reduce([i,0,0,0,0,0,0,0,0], lambda c, s: case when c & 1 = 1 then xor(3988292384::bigint, c >> 1) else c >> 1 end) order by i) t from (select unnest(range(256)) i) q)"""
_CRC = r"""xor(list_reduce(list_prepend(4294967295::bigint, list_filter(list_transform(string_split(regexp_replace(hex(encode({x})), '(..)', '\1,', 'g'), ','),
  lambda h: case when h<>'' then ('0x'||h)::bigint end), lambda b: b is not null)), lambda c, b: xor(t[(xor(c, b) & 255)+1], c >> 8)), 4294967295::bigint)"""
_P = (1 << 31) - 1


def _feistel(seed: int) -> str:
    """The network's rounds as SQL over l and r, each in a query of its own."""
    sql = "select x, rnd, n, h, z >> h l, z & ((1 << h)-1) r from {0}"
    for a, b, c in round_keys(seed):
        sql = f"select x, rnd, n, h, r l, xor(l, xor(y, y >> 13) & ((1 << h)-1)) r from (select *, (xor(w, w >> 15)*{c}+{a}) % {_P} y from (select *, (r*{a}+{b}) % {_P} w from ({sql})))"
    return f"select x, rnd+1 rnd, n, h, (l << h) | r z from ({sql})"


# Rows are numbered by id; the permutation is applied again for as long as it leaves the range.
SHARDS = f"""with recursive {_CRC_TABLE}, d as (select doc_id, octet_length(encode(coalesce(text, '')))+8 as size, {_CRC.format(x="coalesce(text, '')")} crc, row_number() over (order by doc_id)-1 x from documents, tb),
 n as (select count(*) n, greatest(1, cast(ceil(ceil(log2(count(*)))/2) as int)) h from d),
 w as (select x, 0 rnd, n, h, x z from d, n union all {_feistel(13).format("(select * from w where rnd=0 or z>=n)")}), z as (select x, z from w where rnd>0 and z<n)
 select doc_id, cast(size as bigint) size, crc text_crc32, 'rows' law, cast(z % 24 as int) shard, z // 24 slot, cast(null as int) grown_shard, d.x "number" from d join z on z.x=d.x"""

# The grammar's states: 0 before all, 1 after s, 2 after u, 3 after a. A row's edit may be followed by up to two insertions.
REPAIR = f"""with recursive {_CRC_TABLE}, src as (select conv_id, turn, coalesce(role, ' ') r, coalesce(text, ' ') x, {_CRC.format(x="coalesce(conv_id::varchar, ' ')||':'||coalesce(turn::varchar, ' ')")} % 20 kind from conversations, tb),
 dm as (select conv_id, turn, case when kind=4 then 'user' else r end r, case kind when 1 then '' when 2 then translate(x, '.!?', '') else x end x, c copy from src, unnest(case kind when 0 then [] when 3 then [0, 1] else [0] end) u(c)),
 o as (select *, cast(row_number() over (partition by conv_id order by turn nulls first, r, x[1:64], sha256(x), copy) as int) pos, trim(regexp_extract(x, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1)) e from dm),
 f as (select *, case when e='' then 'blank' when row_number() over (partition by conv_id, r, x order by pos)>1 then 'duplicate' when e not in ('.','!','?') then 'truncated' else '' end fault,
   case when lag(r) over w is not null and lag(r) over w[1:1]||r[1:1] not in ('su','ua','au') then 1 else 0 end bad from o window w as (partition by conv_id order by pos)),
 g as (select *, case when fault in ('blank','duplicate') then 'x' when r[1:1] in ('s','u','a') then r[1:1] else 'o' end code, (fault='truncated')::int late from f),
 nx(p, i, q) as (values (0,'s',1),(0,'u',2),(1,'u',2),(2,'a',3),(3,'u',2)),
 ins(p, q, c, a) as (select s, s, 0, '' from range(4) t(s) union all select p, q, 2, 'I' from nx where i<>'s' union all select x.p, y.q, 4, 'II' from nx x join nx y on y.p=x.q where x.i<>'s' and y.i<>'s'),
 ed(code, p, q, c, a, undeleted) as (select k, s, s, 3, 'D', 0 from range(4) t(s), (values ('x'),('s'),('u'),('a'),('o')) v(k) union all select i, p, q, 0, 'K', 1 from nx union all select k, p, q, 2, 'R', 1 from nx, (values ('s'),('u'),('a'),('o')) v(k) where i<>'s' and i<>k),
 tr as (select code, ed.p, ins.q, ed.c+ins.c c, ed.a||ins.a a, undeleted from ed join ins on ins.p=ed.q),
 dp as (select conv_id, 0 pos, q, struct_pack(c := ins.c, a := ins.a) b from (select distinct conv_id from g) k, ins where ins.p=0
   union all select dp.conv_id, dp.pos+1, tr.q, min(struct_pack(c := cast(dp.b.c+tr.c+tr.undeleted*g.late as int), a := dp.b.a||tr.a)) from dp join g on g.conv_id is not distinct from dp.conv_id and g.pos=dp.pos+1 join tr on tr.code=g.code and tr.p=dp.q group by dp.conv_id, dp.pos+1, tr.q),
 ends as (select conv_id, min(b) b from (select *, max(pos) over (partition by conv_id) n from dp) z where pos=n and q in (0, 3) group by conv_id),
 step as (select conv_id, i, b.a[i:i] e from ends, unnest(range(1, len(b.a)+1)) u(i)),
 placed as (select *, sum((e<>'I')::int) over (partition by conv_id order by i) pos, sum((e<>'D')::int) over (partition by conv_id order by i) nth from step),
 line as (select p.conv_id, p.i, p.e, p.nth, g.r, case when p.e='I' then '' else g.x end x, bool_or(p.nth=1 and p.e='K' and g.r[1:1]='s') over (partition by p.conv_id) has_s from placed p left join g on g.conv_id is not distinct from p.conv_id and g.pos=p.pos where p.e<>'D'),
 made as (select conv_id, string_agg(case when e='K' then r when (nth-has_s::int) % 2=1 then 'user' else 'assistant' end||':'||x, chr(10) order by i) t from line group by conv_id),
 stat as (select conv_id, coalesce(max(turn)-min(turn)+1-count(distinct turn), 0) gaps, count(*) filter (fault='blank') blank, count(*) filter (fault='duplicate') "duplicate", count(*) filter (fault='truncated') truncated, sum(bad) illegal from g group by conv_id)
 select k.conv_id, cast(coalesce(gaps, 0) as bigint) gaps, coalesce(blank, 0) blank, coalesce("duplicate", 0) "duplicate", coalesce(truncated, 0) truncated, cast(coalesce(illegal, 0) as bigint) illegal, cast(coalesce(ends.b.c, 0) as bigint) "cost", coalesce(ends.b.a, '') audit, sha256(coalesce(t, '')) repaired_sha256
 from (select distinct conv_id from conversations) k left join stat on stat.conv_id is not distinct from k.conv_id left join ends on ends.conv_id is not distinct from k.conv_id left join made on made.conv_id is not distinct from k.conv_id"""
