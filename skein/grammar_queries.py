"""Registered queries of the grammar: masks of the automaton, patterns over scene trees, and their ambiguity.

Surfaces are read from texts: every sentence of a conversation, each of its words standing for a
token of the demonstration lexicon by its length and its first and last letters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import automaton as am
from skein.functions.grammar import scene_nodes
from skein.operators import gloss, matching
from skein.queries import LEXICON, query

#: what words stand for; classes that open and close a surface come more often
SPOKEN = ["qu", "ti", "mo", "ka", "un", "fe", "ta", "ki", "re", "zisa", "wo", "li", "ko", "mo", "ma", "fe", "su", "zizisa", "te", "ta", "ka", "ap", "da", "re"]
MASK = am.Automaton(LEXICON)


def sentences(t) -> DataFrame:
    """(conv_id, turn, tokens): the sentences of all turns that have words."""
    words = F.expr("regexp_extract_all(lower(sentence), '[a-z]+', 0)")
    spoken = F.array(*map(F.lit, SPOKEN))
    place = lambda w: F.pmod(F.length(w) * 7 + F.ascii(w) * 3 + F.ascii(F.right(w, F.lit(1))) * 5, F.lit(len(SPOKEN)))
    rows = t("conversations").select("conv_id", "turn", F.explode(F.split(F.coalesce("text", F.lit("")), r"[.!?\n]+")).alias("sentence"))
    return rows.select("conv_id", "turn", F.transform(words, lambda w: F.get(spoken, place(w))).alias("tokens")).filter(F.size("tokens") > 0)


_CODES = {token: (letter, cost) for token, (letter, cost) in LEXICON.table.items()}
#: sentences as token lists, with the string of their classes and their lengths, in SQL
SPOKEN_SQL = f"""spoken as (select {SPOKEN!r} as l),
 codes as (select map({list(_CODES)!r}, {[c for c, _ in _CODES.values()]!r}) as letters, map({list(_CODES)!r}, {[n for _, n in _CODES.values()]!r}) as costs),
 w as (select conv_id, turn, regexp_extract_all(lower(s), '[a-z]+') as words from (select conv_id, turn, unnest(string_split_regex(coalesce(text, ''), '[.!?\n]+')) as s from conversations)),
 s as (select row_number() over () as i, conv_id, turn, list_transform(words, lambda w: l[1 + (length(w) * 7 + ascii(w) * 3 + ascii(right(w, 1)) * 5) % {len(SPOKEN)}]) as tokens from w, spoken where len(words) > 0)"""
#: a prefix is legal if some number of roots and a force complete it within the length, or if it is complete
MASK_SQL = f"""{SPOKEN_SQL},
 k as (select unnest(range({LEXICON.depth + 2})) as k),
 p as (select i, n, array_to_string(list_transform(tokens[:n], lambda t: letters[t]), '') as w, coalesce(list_sum(list_transform(tokens[:n], lambda t: costs[t])), 0)::int as used
       from (select i, tokens, unnest(range(least(len(tokens), {LEXICON.most}) + 1)) as n from s), codes),
 read as (select i, max(n) as n from (select i, n from p, k where regexp_matches(w || repeat('R', k) || 'F', '{LEXICON.pattern()}') and used + k + 1 <= {LEXICON.most}
          union all select i, n from p where regexp_matches(w, '{LEXICON.pattern()}') and used <= {LEXICON.most}) group by i),
 c as (select * from (values {', '.join(f"({j}, '{c}', {n}, '{c if c != 'A' else f'A{n - 1}'}')" for j, c in enumerate(am.CLASSES) for n in ([1] if c != 'A' else range(2, LEXICON.repetitions + 2)))}) v(j, c, cost, name)),
 offers as (select distinct p.i, c.j, c.c, c.cost, c.name from p join read using (i, n), c, k
            where regexp_matches(w || c || case when c = 'F' then '' else repeat('R', k) || 'F' end, '{LEXICON.pattern()}') and used + cost + case when c = 'F' then 0 else k + 1 end <= {LEXICON.most}),
 best as (select i, j, max_by(name, cost) as name from offers group by i, j),
 names as (select i, string_agg(name, ' ' order by j) as classes from best group by i)"""


@query(f"""with {MASK_SQL} select s.conv_id, s.turn, array_to_string(s.tokens, ' ') as surface, read.n::int as n_read, p.used, coalesce(names.classes, '') as next_classes,
 read.n = len(s.tokens) and regexp_matches(p.w, '{LEXICON.pattern()}') as accepted from s join read using (i) join p on p.i = s.i and p.n = read.n left join names on names.i = s.i""")
def mask_walk(t):
    """the longest legal prefix of each sentence and the classes that may follow it, with what is left of the length."""
    s = sentences(t).withColumn("at", am.walk(F.col("tokens"), MASK))
    done = (F.col("at.state") == MASK.done) & (F.col("at.read") == F.size("tokens"))
    return s.select("conv_id", "turn", F.array_join("tokens", " ").alias("surface"), F.col("at.read").alias("n_read"), F.col("at.used").alias("used"), F.array_join(am.legal_next(F.col("at"), MASK), " ").alias("next_classes"), done.alias("accepted"))


_FORMS_SQL = " union all ".join(
    f"select '{name}' as name, {form!r} as form"
    for c in am.CLASSES
    for name, form in ([(c, f) for f in LEXICON.classes[c]] if c != "A" else [(f"A{n}", f * k + LEXICON.closer) for n in range(1, LEXICON.repetitions + 1) for f in LEXICON.classes["A"] for k in range(1, n + 1)])
)


@query(f"""with {MASK_SQL}, f as ({_FORMS_SQL}), g as (select i, string_agg(form, ' ' order by form) as forms, count(*) as n from best join f using (name) group by i)
 select coalesce(g.forms, '') as forms, coalesce(g.n, 0) as n_forms, count(*) as sentences from s left join g using (i) group by all""")
def mask_forms(t):
    """the surface forms that may follow the longest legal prefix, and for how many sentences each such set is the mask."""
    s = sentences(t).withColumn("at", am.walk(F.col("tokens"), MASK))
    forms = am.legal_forms(am.legal_next(F.col("at"), MASK), LEXICON)
    return s.select(F.array_join(forms, " ").alias("forms"), F.size(forms).cast("long").alias("n_forms")).groupBy("forms", "n_forms").agg(F.count("*").alias("sentences"))


#: settings of an axis: which forces and modals it allows
AXES = [("all", None, None), ("asked", ["ka"], None), ("plain", None, []), ("asked_plain", ["ka", "ki"], []), ("none", [], None)]
_AXES_SQL = ", ".join(f"('{a}', {'null' if f is None else f'{f!r}::varchar[]'}, {'null' if m is None else f'{m!r}::varchar[]'})" for a, f, m in AXES)


@query(f"""with {SPOKEN_SQL}, x as (select tokens[-1] as force, list_filter(tokens, lambda t: t = 'ma')[1] as modal from s where tokens[-1] in ('ka', 'ki', 'ko')),
 a as (select * from (values {_AXES_SQL}) v(axis, forces, modals))
 select axis, count(*) filter ((forces is null or list_contains(forces, force)) and (modals is null or modal is null or list_contains(modals, modal))) as permitted, count(*) as sentences from x, a group by axis""")
def axis_permits(t):
    """sentences whose force and modal the allow-lists of each axis let pass."""
    s = sentences(t).select(F.element_at("tokens", -1).alias("force"), F.get(F.filter("tokens", lambda x: x.isin(*LEXICON.classes["M"])), 0).alias("modal")).filter(F.col("force").isin(*LEXICON.classes["F"]))
    n = s.groupBy("force", "modal").agg(F.count("*").alias("n"))
    lists = F.array(*(F.struct(F.lit(a).alias("axis"), (F.lit(None).cast("array<string>") if f is None else F.array(*map(F.lit, f)).cast("array<string>")).alias("forces"), (F.lit(None).cast("array<string>") if m is None else F.array(*map(F.lit, m)).cast("array<string>")).alias("modals")) for a, f, m in AXES))
    rows = n.select("force", "modal", "n", F.inline(lists))
    ok = am.permits(F.col("force"), F.col("forces"), F.col("modal"), F.col("modals"))
    return rows.groupBy("axis").agg(F.sum(F.when(ok, F.col("n")).otherwise(0)).alias("permitted"), F.sum("n").alias("sentences"))


def completed(t) -> DataFrame:
    """(surface, n): different surfaces that the legal prefixes of all sentences come to once their roots and force are added."""
    s = sentences(t).withColumn("at", am.walk(F.col("tokens"), MASK))
    due = F.get(F.expr("array(" + ",".join(map(str, MASK.due)) + ")"), F.col("at.state"))
    roots = F.array(*map(F.lit, LEXICON.classes["R"]))
    more = F.when(due == 0, F.array().cast("array<string>")).otherwise(
        F.concat(F.transform(F.slice(F.array(*map(F.lit, range(8))), F.lit(1), due - 1), lambda j: F.get(roots, (F.size("tokens") + j) % len(LEXICON.classes["R"]))), F.array(F.lit("ka")))
    )
    surface = F.array_join(F.concat(F.slice("tokens", F.lit(1), F.col("at.read")), more), " ")
    return s.select(surface.alias("surface")).groupBy("surface").agg(F.count("*").alias("n"))


def scene_table(t) -> tuple[DataFrame, DataFrame]:
    """The node table of the completed surfaces in which no node has two clauses of one relator, and their weights (id, n)."""
    made = completed(t)
    nodes = scene_nodes(made.select(F.col("surface").alias("id"), F.col("surface").alias("said")), "id", "said", LEXICON)
    twice = nodes.filter("depth > 0").groupBy("id", F.slice("path", 1, F.size("path") - 1).alias("above"), "relator").count().filter("count > 1").select("id").distinct()
    return nodes.join(twice, "id", "left_anti"), made.select(F.col("surface").alias("id"), "n")


def _root(i) -> F.Column:
    return F.get(F.array(*map(F.lit, LEXICON.classes["R"])), F.pmod(i, F.lit(len(LEXICON.classes["R"]))).cast("int"))


def referents(t) -> DataFrame:
    """A referent for each nation, its patterns taken from the nation's key and the length of its name."""
    key, name = F.col("n_nationkey").cast("int"), F.length("n_name")
    list_if = lambda c, *forms: F.when(c, F.array(*map(F.lit, forms)))

    def pattern(j) -> F.Column:
        first = key * 3 + j * 2 + name
        roots = F.when((key + j) % 2 == 0, F.array(_root(first), _root(first + 1))).otherwise(F.array(_root(first)))
        via = list_if((j > 0) & (key % 3 == 1), "fe")
        at_depth = F.when((j > 0) & (key % 4 == 2), F.lit(1))
        return F.struct(
            roots.alias("roots"), list_if((key + j) % 4 == 1, "un").alias("orients"), list_if((key + j) % 5 == 2, "zi").alias("aspects"),
            list_if((j == 0) & (key % 6 == 3), "wo").alias("relators"), via.alias("via"), at_depth.alias("at_depth"), F.lit(None).cast("array<string>").alias("residues"),
        )

    def plain(first) -> F.Column:
        none = F.lit(None).cast("array<string>")
        return F.struct(F.array(_root(first)).alias("roots"), none.alias("orients"), none.alias("aspects"), none.alias("relators"), none.alias("via"), F.lit(None).cast("int").alias("at_depth"), none.alias("residues"))

    contains = F.transform(F.sequence(F.lit(0), key % 3), pattern)
    forbid = F.when(key % 5 == 4, F.array(plain(key * 3 + name + 3)))
    matrix = F.when(key % 4 == 3, plain(key * 3 + name))
    return t("nation").select(
        F.col("n_name").alias("id"), F.lit("nations").alias("family"), F.lit("REVIEWED").alias("status"), (key % 7 != 3).alias("seed"), contains.alias("contains"), forbid.alias("forbid"), matrix.alias("matrix")
    )


def live(t) -> DataFrame:
    return matching.patterns_of(matching.load(referents(t), LEXICON))


_R = list(LEXICON.classes["R"])
#: the completed surfaces and their weights
MADE_SQL = f"""{MASK_SQL},
 due as (select i, n, min(k) as k from p join read using (i, n), k where regexp_matches(w || repeat('R', k) || 'F', '{LEXICON.pattern()}') group by all),
 made as (select array_to_string(s.tokens[:read.n] || case when due.k is null then [] else list_transform(range(due.k), lambda j: {_R!r}[1 + (len(s.tokens) + j) % {len(_R)}]) || ['ka'] end, ' ') as surface
          from s join read using (i) left join due using (i)),
 weights as (select surface, count(*) as n from made group by surface)"""
#: the node table, by a walk over the tokens that keeps the path of the innermost predication and the clauses of all open ones
NODES_SQL = f"""{MADE_SQL},
 steps as (
  select surface, string_split(surface, ' ') as toks, 0 as pos, []::int[] as path, false as rooted, [0] as kids, null::varchar as tok, null::varchar as c, []::int[] as spot from weights
  union all
  select surface, toks, pos + 1, case when c2 = 'L' then p1 || [k1[-1]] else p1 end, case c2 when 'L' then false when 'R' then true else rooted and not pop end,
   case when c2 = 'L' then list_slice(k1, 1, len(k1) - 1) || [k1[-1] + 1, 0] else k1 end, t2, c2, case when c2 = 'L' then p1 || [k1[-1]] else p1 end
  from (select *, case when pop then list_slice(path, 1, len(path) - 1) else path end as p1, case when pop then list_slice(kids, 1, len(kids) - 1) else kids end as k1
        from (select *, rooted and c2 not in ('A', 'D', 'F') as pop from (select steps.*, toks[pos + 1] as t2, letters[toks[pos + 1]] as c2 from steps, codes where pos < len(toks))))),
 all_nodes as (select surface, spot as path, len(spot) as depth, max(tok) filter (c = 'R') as root, list(tok) filter (c = 'O') as orients, case when count(*) filter (c = 'A') > 0 then 'zi' end as aspect, max(tok) filter (c = 'L') as relator,
                max(tok) filter (c = 'Q') as quant, max(tok) filter (c = 'T') as tense, max(tok) filter (c = 'M') as modal, max(tok) filter (c = 'D') as degree, max((length(tok) - 2) // 2) filter (c = 'A') as reps
               from steps where pos > 0 and c <> 'F' group by surface, spot),
 outs as (select surface, list_slice(path, 1, len(path) - 1) as path, list(relator) as out, count(*) - count(distinct relator) as twice from all_nodes where depth > 0 group by all),
 nodes as (select a.*, o.out from all_nodes a left join outs o using (surface, path) where surface not in (select surface from outs where twice > 0))"""
#: the referents of the nations, one row for each pattern
REF_SQL = f"""{NODES_SQL},
 refs as (select n_name as ref, n_nationkey::int as key, length(n_name) as name, n_nationkey % 3 + 1 as k from nation where n_nationkey % 7 <> 3),
 pats as (select ref, 'contains' as role, j::int as ord, case when (key + j) % 2 = 0 then [{_R!r}[1 + (key * 3 + j * 2 + name) % 5], {_R!r}[1 + (key * 3 + j * 2 + name + 1) % 5]] else [{_R!r}[1 + (key * 3 + j * 2 + name) % 5]] end as roots,
   (key + j) % 4 = 1 as un, (key + j) % 5 = 2 as zi, j = 0 and key % 6 = 3 as wo, j > 0 and key % 3 = 1 as fe, j > 0 and key % 4 = 2 as one from (select *, unnest(range(k)) as j from refs)
  union all select ref, 'forbid', 0, [{_R!r}[1 + (key * 3 + name + 3) % 5]], false, false, false, false, false from refs where key % 5 = 4
  union all select ref, 'matrix', 0, [{_R!r}[1 + (key * 3 + name) % 5]], false, false, false, false, false from refs where key % 4 = 3),
 fit as (select surface, ref, role, ord, path from nodes join pats on list_contains(roots, root) where (not un or list_contains(orients, 'un')) and (not zi or aspect = 'zi') and (not wo or list_contains(out, 'wo'))
   and (role <> 'contains' or ((not fe or (depth = 1 and relator = 'fe')) and (not one or depth = 1)))),
 free as (select w.surface, refs.ref, refs.k from (select distinct surface from nodes) w, refs
   where not exists (from fit f where f.surface = w.surface and f.ref = refs.ref and f.role = 'forbid')
   and (refs.key % 4 <> 3 or exists (from fit f where f.surface = w.surface and f.ref = refs.ref and f.role = 'matrix' and f.path = []::int[]))),
 given as (select surface, ref, k, 0 as ord, []::varchar[] as used from free
   union all select g.surface, g.ref, g.k, g.ord + 1, g.used || [f.path::varchar] from given g join fit f on f.surface = g.surface and f.ref = g.ref and f.role = 'contains' and f.ord = g.ord and not list_contains(g.used, f.path::varchar)),
 matched as (select distinct surface, ref from given where ord = k),
 numbered as (select surface, path, row_number() over (partition by surface order by path::varchar) - 1 as spot, count(*) over (partition by surface) as n from nodes),
 taken as (select f.surface, f.ref, n.n, 0 as spot, []::int[] as used from free f join (select distinct surface, n from numbered) n using (surface) where n.n <= f.k
   union all select g.surface, g.ref, g.n, g.spot + 1, g.used || [f.ord] from taken g join numbered m on m.surface = g.surface and m.spot = g.spot join fit f on f.surface = g.surface and f.ref = g.ref and f.role = 'contains' and f.path = m.path and not list_contains(g.used, f.ord)),
 possible as (select distinct surface, ref from taken where spot = n)"""


@query(f"with recursive {REF_SQL} select surface, ref from matched")
def referent_matches(t):
    """The referents that each scene of the texts states in full."""
    return matching.matching(scene_table(t)[0], live(t)).select(F.col("id").alias("surface"), "ref")


@query(f"with recursive {REF_SQL} select surface, ref from possible")
def referent_consistent(t):
    """The referents that each scene still leaves possible."""
    return matching.consistent(scene_table(t)[0], live(t)).select(F.col("id").alias("surface"), "ref")


@query(f"""with recursive {REF_SQL}, a as (select w.surface, w.n, count(m.ref) as fits from weights w left join matched m using (surface) where surface in (select surface from nodes) group by all)
 select fits, sum(n)::bigint as scenes, count(*) as surfaces from a group by fits""")
def ambiguity_spread(t):
    """How many scenes fit how many referents, none included."""
    nodes, weights = scene_table(t)
    fits = matching.ambiguity(matching.matching(nodes, live(t)), nodes).join(weights.withColumnRenamed("n", "w"), "id")
    return fits.groupBy(F.col("n").alias("fits")).agg(F.sum("w").alias("scenes"), F.count("*").alias("surfaces"))


@query(f"with recursive {REF_SQL} select a.ref as a, b.ref as b, sum(w.n)::bigint as n from matched a join matched b on a.surface = b.surface and a.ref < b.ref join weights w on w.surface = a.surface group by a.ref, b.ref")
def colliding_pairs(t):
    """Pairs of referents that the same scenes state, with their number."""
    nodes, weights = scene_table(t)
    return matching.colliding(matching.matching(nodes, live(t)), weights)


@query(f"""with recursive {REF_SQL}, counted as (select n.surface, n.n as nodes, count(p.ref) as m from (select distinct surface, n from numbered) n left join possible p using (surface) group by all)
 select nodes, count(*) as surfaces, round(avg(m), 6) as mean_possible, max(m) as most, count(*) filter (m >= 2) as ambiguous from counted group by nodes""")
def ambiguity_by_nodes(t):
    """The referents that stay possible, by the number of uttered nodes."""
    nodes, _ = scene_table(t)
    size = nodes.groupBy("id").agg(F.count("*").alias("nodes"))
    m = matching.ambiguity(matching.consistent(nodes, live(t)), nodes).join(size, "id")
    return m.groupBy("nodes").agg(F.count("*").alias("surfaces"), F.round(F.avg("n"), 6).alias("mean_possible"), F.max("n").alias("most"), F.count_if(F.col("n") >= 2).alias("ambiguous"))


WORDS = gloss.Glosses(
    {
        "R": {"mo": "rains", "ta": "glows", "re": "stops", "li": "flies", "su": "makes"}, "O": {"un": "upward", "ap": "apart"}, "L": {"fe": "after", "wo": "beside"}, "A": {"zi": "again"},
        "M": {"ma": "remembered"}, "D": {"da": "bright"}, "Q": {"qu": "often"}, "T": {"ti": "long ago", "te": "soon"},
    },
    {"ka": ".", "ki": "?", "ko": "!"},
)
GERUNDS = {"rains": "raining", "glows": "glowing", "stops": "stopping", "flies": "flying", "makes": "making"}


def _word(letter: str, form: str) -> str:
    return "case " + form + " " + " ".join(f"when '{k}' then '{v}'" for k, v in WORDS.words[letter].items()) + " end"


def _fold_sql(say, name: str) -> str:
    """One CTE for each level, the deepest first."""
    out = []
    for d in range(LEXICON.depth, -1, -1):
        kids = f"left join (select surface, list_slice(path, 1, len(path) - 1) as path, list(struct_pack(relator := relator, text := text) order by relator, text) as clauses from {name}{d + 1} group by all) k using (surface, path)" if d < LEXICON.depth else "left join (select null::varchar as surface, null::int[] as path, null::struct(relator varchar, text varchar)[] as clauses) k using (surface, path)"
        out.append(f"{name}{d} as (select surface, path, relator, {say(d == 0)} as text from (select n.*, list_sort(coalesce(orients, [])) as orient, coalesce(clauses, []) as clauses from nodes n {kids} where depth = {d}))")
    return ", ".join(out)


_TIMES = "case when reps > 1 then ' x' || reps else '' end"
_CODA = "case string_split(surface, ' ')[-1] " + " ".join(f"when '{k}' then '{v}'" for k, v in WORDS.codas.items()) + " end"


def _gloss_sql(top: bool) -> str:
    return f"""concat_ws(', ', {_word('Q', 'quant')}, {_word('T', 'tense')}, {_word('M', 'modal')}, nullif(array_to_string(list_transform(orient, lambda o: {_word('O', 'o')}), ', '), ''),
     nullif(array_to_string(list_transform(clauses, lambda c: {_word('L', 'c.relator')} || ' [' || c.text || ']'), ', '), ''), {_word('R', 'root')}, {_word('A', 'aspect')} || {_TIMES}, {_word('D', 'degree')} || 'ly')"""


def _prose_sql(top: bool) -> str:
    orients = f"nullif(array_to_string(list_transform(orient, lambda o: {_word('O', 'o')}), ' and '), '')"
    clauses = f"nullif(array_to_string(list_transform(clauses, lambda c: {_word('L', 'c.relator')} || ' ' || c.text), ', '), '')"
    frames = f"{_word('Q', 'quant')}, {_word('T', 'tense')}, 'as ' || {_word('M', 'modal')}"
    rest = f"{_word('D', 'degree')} || 'ly', {_word('A', 'aspect')} || {_TIMES}"
    if top:
        return f"concat_ws(', ', {frames}, {orients}, {clauses}, 'it ' || {_word('R', 'root')}, {rest})"
    verb = "case root " + " ".join(f"when '{k}' then '{GERUNDS[v]}'" for k, v in WORDS.words["R"].items()) + " end"
    more = f"concat_ws(', ', {rest}, {orients}, {clauses}, {frames})"
    return f"'a ' || {verb} || case when {more} = '' then '' else ' - ' || {more} || ' -' end"


@query(f"with recursive {NODES_SQL}, {_fold_sql(_gloss_sql, 'g')} select surface, text || {_CODA} as text from g0")
def scene_gloss(t):
    """Every scene in plain words, part by part."""
    return gloss.gloss(scene_table(t)[0], WORDS, LEXICON.depth).withColumnRenamed("id", "surface")


@query(f"with recursive {NODES_SQL}, {_fold_sql(_prose_sql, 'g')}, x as (select surface, replace(text, '-, ', '- ') as s from g0) select surface, upper(s[1]) || s[2:] || {_CODA} as text from x")
def scene_prose(t):
    """Every scene as a sentence, embedded happenings as gerunds."""
    return gloss.prose(scene_table(t)[0], WORDS, LEXICON.depth).withColumnRenamed("id", "surface")


def _denoted_sql(top: bool) -> str:
    return "root || '|' || coalesce(aspect, '') || '|' || array_to_string(orient, ',') || '|' || array_to_string(list_sort(list_transform(clauses, lambda c: c.relator || '(' || c.text || ')')), ',')"


@query(f"with recursive {NODES_SQL}, {_fold_sql(_denoted_sql, 'g')} select surface, min(surface) over (partition by text) as first, count(*) over (partition by text) as n from g0")
def scene_impressions(t):
    """Scenes that denote the same, decoration and order aside."""
    return gloss.compatible(scene_table(t)[0]).withColumnRenamed("id", "surface")
