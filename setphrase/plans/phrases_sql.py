"""SQL for the steps that several queries share, as common table expressions."""

from __future__ import annotations

TF, COOC, SKIP = 10, 10, 4

DOCS = r"docs as materialized (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '') as w from documents where text is not null)"
TOK = f"{DOCS}, tok as materialized (select doc_id, unnest(w) as term, (generate_subscripts(w, 1) - 1)::int as pos from docs)"
VOCAB = f"{TOK}, tf as materialized (select term, count(*) as tf from tok group by term), minv as materialized (select * from tf where tf >= {TF})"
MASKED = f"{VOCAB}, m as materialized (select doc_id, pos, tok.term, case when minv.tf is not null then tok.term end as st, minv.tf as tf from tok left join minv on minv.term = tok.term)"
PAIRS = f"""{MASKED}, near as materialized (select a.doc_id, a.pos as p1, b.pos as p2, a.st as t1, b.st as t2 from m a join m b on a.doc_id = b.doc_id and b.pos > a.pos and b.pos <= a.pos + {SKIP + 1}
  where a.st is not null and b.st is not null),
cooc as materialized (select t1, t2, count(*) as freq from near group by t1, t2)"""


def chosen(neighbours: int = 1) -> str:
    return f"""{PAIRS}, strong as materialized (select near.* from near join cooc using (t1, t2) where freq >= {COOC} and p2 - p1 <= 4),
credit as materialized (select doc_id, p as pos from (select doc_id, p1 as p from strong union all select doc_id, p2 from strong) group by doc_id, p having count(*) >= {neighbours}),
sel as materialized (select m.doc_id, m.pos, m.term, case when credit.doc_id is not null and m.tf >= {COOC} then m.st end as sel from m left join credit on m.doc_id = credit.doc_id and m.pos = credit.pos)"""


ISLANDS = f"""{chosen()}, isl as (select *, sum((sel is null)::int) over (partition by doc_id order by pos) as g from sel),
runs as materialized (select doc_id, min(pos) as start, list(sel order by pos) as terms from isl where sel is not null group by doc_id, g)"""


def greedy(k: int, body: str) -> str:
    """Runs with up to k slots, and a query over them; runs open one after the other, so they are walked recursively."""
    return f"""with recursive {chosen()},
numbered as materialized (select doc_id, pos, sel, term, sum((sel is null)::int) over (partition by doc_id order by pos) as before, count(*) over (partition by doc_id) as n from sel),
nulls as materialized (select doc_id, pos, before as i from numbered where sel is null),
spans as materialized (select s.doc_id, s.pos, coalesce(e.pos, s.n)::int as stop from numbered s left join nulls e on e.doc_id = s.doc_id and e.i = s.before + {k + 1} where s.sel is not null),
linked as materialized (select a.doc_id, a.pos, a.stop, b.pos as nxt from spans a asof left join spans b on a.doc_id = b.doc_id and b.pos >= a.stop),
walk as (
  select doc_id, arg_min(pos, pos) as pos, arg_min(stop, pos) as stop, arg_min(nxt, pos) as nxt from linked group by doc_id
  union all
  select l.doc_id, l.pos, l.stop, l.nxt from walk w join linked l on l.doc_id = w.doc_id and l.pos = w.nxt),
runs as materialized (select w.doc_id, w.pos as start, list(coalesce(s.sel, '<VAR>') order by s.pos) as terms, count(s.sel) as kept, string_agg(coalesce(s.sel, '<VAR>'), ' ' order by s.pos) as phrase,
    coalesce(string_agg(s.term, ' ' order by s.pos) filter (s.sel is null), '') as variables
  from walk w join sel s on s.doc_id = w.doc_id and s.pos >= w.pos and s.pos < w.stop group by 1, 2)
{body}"""
