"""F and G: strings, identities, text, numbers, arrays, JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import columns as col
from tessera.functions import text as txt
from tessera.operators import kernels
from tessera.operators.matching import literal_hits
from tessera.operators.order import hash_positions

from .base import CELLS, EFFECTS, Tables, cells, effects, query, r6


@query("f01_joined_hash", "select p_partkey, sha256(p_name) as text_hash, substr(sha256(concat_ws(chr(31), p_brand, p_type, p_size::varchar)), 1, 24) as key from part")
def f01(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.sha2("p_name", 256).alias("text_hash"), col.joined_hash(F.col("p_brand"), F.col("p_type"), F.col("p_size"), digits=24).alias("key"))


@query("f02_sha1_key", "select p_partkey, p_brand || '::ctx::' || substr(sha1(p_type), 1, 16) as key from part")
def f02(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.concat("p_brand", F.lit("::ctx::"), F.substring(F.sha1("p_type"), 1, 16)).alias("key"))


@query("f03_json_hash_id", """select p_partkey, 'atom:' || substr(sha256('["' || p_brand || '","' || p_type || '"]'), 1, 24) as id from part""")
def f03(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.concat(F.lit("atom:"), F.substring(F.sha2(F.to_json(F.array("p_brand", "p_type")), 256), 1, 24)).alias("id"))


@query("f04_axis_digest", "select n_regionkey::bigint as region, sha256(string_agg(n_name, chr(10) order by n_name)) as digest from nation group by 1")
def f04(t: Tables) -> DataFrame:
    return t.nation.groupBy(F.col("n_regionkey").cast("bigint").alias("region")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("n_name")), "\n"), 256).alias("digest"))


@query("f05_catalog_hash", "select lang, sha256(string_agg(sha256(text), chr(10) order by doc_id)) as catalog from documents group by 1")
def f05(t: Tables) -> DataFrame:
    h = t.documents.select("lang", F.struct("doc_id", F.sha2("text", 256).alias("h")).alias("x"))
    return h.groupBy("lang").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["h"]), "\n"), 256).alias("catalog"))


@query("f06_multiset_signature", """select l_orderkey, sha256('[' || string_agg(l_partkey::varchar, ',' order by l_partkey) || ']') as signature from lineitem group by 1""")
def f06(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(F.sha2(F.to_json(F.array_sort(F.collect_list("l_partkey"))), 256).alias("signature"))


ODD = """odd as (select event_id, case event_id % 8 when 0 then ' NaN ' when 1 then '' when 2 then 'Unknown' when 3 then '<NA>' when 4 then 'n/a' else '  ' || event_type || ' ' end as raw from events)"""


def odd(t: Tables) -> DataFrame:
    k = F.col("event_id") % 8
    raw = F.when(k == 0, " NaN ").when(k == 1, "").when(k == 2, "Unknown").when(k == 3, "<NA>").when(k == 4, "n/a").otherwise(F.concat(F.lit("  "), "event_type", F.lit(" ")))
    return t.events.select("event_id", raw.alias("raw"))


@query("f07_clean_values", f"""with {ODD}, c as (select event_id, trim(raw) as x, lower(trim(raw)) as l from odd), d as (select *, case when l in ('', 'nan', 'none', 'null', '<na>', 'na') then null else x end as clean from c)
  select event_id, clean, case when lower(clean) in ('unknown', 'unknown_donor', 'not_applicable', '__mixed__') then null else clean end as supported, coalesce(clean, 'MISSING') as sentinel, clean is null or l in ('n/a', 'unk', 'unknown') as prompt_missing from d""")
def f07(t: Tables) -> DataFrame:
    r = F.col("raw")
    return odd(t).select("event_id", col.clean_value(r).alias("clean"), col.supported_value(r).alias("supported"), col.sentinel_value(r).alias("sentinel"), col.prompt_missing(r).alias("prompt_missing"))


@query("f08_squeeze", r"select doc_id, sha256(trim(regexp_replace(text, '[ \t\n\x0b\f\r]+', ' ', 'g'))) as h from documents")
def f08(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2(col.squeeze(F.col("text")), 256).alias("h"))


@query("f09_family", "select p_partkey, case when x like '%crispr%' then 'genetic' when x like '%cytokine%' then 'cytokine' when x like '%drug%' then 'chemical' else 'other' end as family from (select p_partkey, case p_partkey % 4 when 0 then 'crispr of ' when 1 then 'a cytokine ' when 2 then 'drug ' else '' end || lower(p_name) as x from part)")
def f09(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 4
    x = F.concat(F.when(k == 0, "CRISPR of ").when(k == 1, "a Cytokine ").when(k == 2, "Drug ").otherwise(""), "p_name")
    return t.part.select("p_partkey", txt.family(x).alias("family"))


@query("f10_canonical_entities", "select o_custkey, array_to_string(list_sort(list_distinct(string_split(string_agg(p, ','), ','))), '+') as entities from (select o_custkey, o_orderpriority || ',' || o_orderstatus as p from orders) group by 1")
def f10(t: Tables) -> DataFrame:
    g = t.orders.groupBy("o_custkey").agg(F.array_join(F.collect_list(F.concat_ws(";", "o_orderpriority", "o_orderstatus")), "; ").alias("x"))
    return g.select("o_custkey", txt.canonical_entities(F.col("x")).alias("entities"))


def prompts(t: Tables) -> DataFrame:
    bad = F.when(F.col("p_partkey") % 10 == 0, F.concat(F.lit("Biology: "), "p_type", F.lit(" Identity: "), "p_brand", F.lit(" Technology: x")))
    good = F.concat(F.lit("Identity: "), "p_brand", F.lit(" Biology: "), "p_type", F.lit(" Technology: size "), F.col("p_size").cast("string"))
    return t.part.select("p_partkey", F.coalesce(bad, F.when(F.col("p_partkey") % 10 == 1, F.concat(F.lit("Identity: "), "p_brand")), good).alias("prompt"))


@query("f11_section_views", """select p_partkey, case when p_partkey % 10 = 0 then 'wrong_order' when p_partkey % 10 = 1 then 'missing_section' else 'ok' end as status, case when p_partkey % 10 > 1 then p_brand end as p1,
  case when p_partkey % 10 > 1 then p_brand || ' ' || p_type end as p2, case when p_partkey % 10 > 1 then p_brand || ' size ' || p_size end as p3, case when p_partkey % 10 > 1 then p_brand || ' ' || p_type || ' size ' || p_size end as p4 from part""")
def f11(t: Tables) -> DataFrame:
    v = prompts(t).withColumn("v", txt.views(F.col("prompt")))
    return v.select("p_partkey", "v.status", F.col("v.P1").alias("p1"), F.col("v.P2").alias("p2"), F.col("v.P3").alias("p3"), F.col("v.P4").alias("p4"))


@query("f12_views_without_technology", "select p_partkey, p_brand as identity, p_type as biology from part where p_partkey % 10 > 1")
def f12(t: Tables) -> DataFrame:
    p = prompts(t).where("p_partkey % 10 > 1")
    return p.select("p_partkey", col.section(F.col("prompt"), "Identity:", "Biology:").alias("identity"), col.section(F.col("prompt"), "Biology:", "Technology:").alias("biology"))


@query("f13_context_only", "select p_partkey, p_type as b, p_type || ' | size ' || p_size as be from part where p_partkey % 10 > 1")
def f13(t: Tables) -> DataFrame:
    x = F.col("prompt")
    b, e = F.regexp_extract(x, r"Biology: (.*?) Technology:", 1), F.regexp_extract(x, r"Technology: (.*)$", 1)
    return prompts(t).where("p_partkey % 10 > 1").select("p_partkey", b.alias("b"), F.concat_ws(" | ", b, e).alias("be"))


@query("f14_knowledge_blocks", "select o_custkey, pos::bigint as pos, priority from (select o_custkey, row_number() over (partition by o_custkey order by o_orderpriority) - 1 as pos, o_orderpriority as priority from (select distinct o_custkey, o_orderpriority from orders))")
def f14(t: Tables) -> DataFrame:
    g = t.orders.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_set("o_orderpriority")), lambda x: F.concat(F.lit("Canonical name: "), x, F.lit("."))), "\n---\n").alias("x"))
    block = g.select("o_custkey", F.posexplode(F.split("x", r"\n---\n")).alias("pos", "block"))
    return block.select("o_custkey", F.col("pos").cast("bigint").alias("pos"), F.regexp_extract("block", r"Canonical name: (.*)\.", 1).alias("priority"))


@query("f15_split_ids", "select p_partkey, pos::bigint as pos, id from (select p_partkey, unnest([0, 1]) as pos, unnest([p_brand, p_type]) as id from part)")
def f15(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 4
    x = F.when(k == 0, F.to_json(F.array("p_brand", "p_type"))).when(k == 1, F.concat_ws(" | ", "p_brand", "p_type")).when(k == 2, F.concat_ws(";", "p_brand", "p_type")).otherwise(F.concat_ws("+", "p_brand", "p_type"))
    return t.part.select("p_partkey", F.posexplode(txt.split_ids(x)).alias("pos", "id")).select("p_partkey", F.col("pos").cast("bigint").alias("pos"), "id")


@query("f16_component_entity", "select c_custkey, split_part(c_name, '#', 1) as family, ltrim(split_part(c_name, '#', 2), '0') as entity from customer")
def f16(t: Tables) -> DataFrame:
    part = lambda i: F.split_part("c_name", F.lit("#"), F.lit(i))
    return t.customer.select("c_custkey", part(1).alias("family"), F.ltrim(part(2), F.lit("0")).alias("entity"))


@query("f17_first_present", "select o_orderkey, coalesce(case when o_orderstatus = 'F' then 'a' end, case when o_totalprice > 200000 then 'b' end, 'c') as x from orders")
def f17(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.coalesce(F.when(F.col("o_orderstatus") == "F", "a"), F.when(F.col("o_totalprice") > 200000, "b"), F.lit("c")).alias("x"))


@query("f18_humanize", "select p_partkey, trim(p_brand || ' ' || p_type) as name from part")
def f18(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", txt.humanize(F.concat("p_brand", F.lit("__"), F.col("p_type"), F.lit(".12"))).alias("name"))


@query("f19_render_prompt", """select p_partkey, concat_ws(' ', 'Perturbation of ' || p_brand || '.', case when p_size > 10 then 'Target: ' || p_type || '.' end, 'Dose ' || p_size || ' nM.', case when p_partkey % 2 = 0 then 'Duration 24 h.' end) as prompt from part""")
def f19(t: Tables) -> DataFrame:
    s = F.concat_ws(" ", F.format_string("Perturbation of %s.", "p_brand"), F.when(F.col("p_size") > 10, F.format_string("Target: %s.", "p_type")), F.format_string("Dose %d nM.", "p_size"), F.when(F.col("p_partkey") % 2 == 0, "Duration 24 h."))
    return t.part.select("p_partkey", s.alias("prompt"))


@query("f20_anonymous_views", """with n as (select p_brand, 'entity ' || row_number() over (order by sha256('31|' || p_brand)) as anon from (select distinct p_brand from part))
  select p_partkey, view, case view when 'P1' then anon when 'P2' then anon || ' in ' || p_type when 'P3' then anon || ' at ' || p_size else anon || ' in ' || p_type || ' at ' || p_size end as text from part join n using (p_brand), (values ('P1'), ('P2'), ('P3'), ('P4')) v(view)""")
def f20(t: Tables) -> DataFrame:
    names = hash_positions(t.part.select("p_brand").where("p_brand is not null").distinct(), "p_brand", 31)
    names = names.select("p_brand", F.concat(F.lit("entity "), (F.col("position") + 1).cast("string")).alias("anon"))
    bio, exp = F.concat(F.lit(" in "), "p_type"), F.concat(F.lit(" at "), F.col("p_size").cast("string"))
    views = [F.struct(F.lit(v).alias("view"), F.concat("anon", *parts).alias("text")) for v, parts in (("P1", ()), ("P2", (bio,)), ("P3", (exp,)), ("P4", (bio, exp)))]
    return t.part.join(names, "p_brand").select("p_partkey", F.inline(F.array(*views)))


@query("f21_ellipsis", "select p_partkey, case when length(p_name) > 9 then rtrim(substr(p_name, 1, 9)) || '...' else p_name end as short from part")
def f21(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", col.ellipsis(F.col("p_name"), 9).alias("short"))


@query("f22_literal_leakage", "select lang, bool_or(coalesce(contains(d.text, b.text), false)) as leaks, count(distinct d.doc_id) filter (contains(d.text, b.text))::bigint as n_docs, count(*) filter (contains(d.text, b.text))::bigint as n_hits from documents d, (select distinct text from benchmark where text <> '') b group by 1")
def f22(t: Tables) -> DataFrame:
    # items are found by their rarest inner run of words, then verified
    hits = literal_hits(t.documents, "doc_id", "text", t.benchmark.select(F.col("text").alias("item")), "item")
    d = t.documents.select("doc_id", "lang").join(hits.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left")
    return d.groupBy("lang").agg((F.count("n") > 0).alias("leaks"), F.count("n").alias("n_docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_hits"))


@query("f23_tfidf", r"""with tk as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') as w from benchmark), g as (select item_id, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) as term from tk),
  tf as (select item_id, term, count(*) as tf from g group by all), df as (select term, count(*) as df from tf group by 1), n as (select count(*) as n from benchmark), x as (select item_id, term, tf * (ln((1 + n) / (1 + df)) + 1) as w from tf join df using (term), n)
  select item_id, term, round(w / sqrt(sum(w * w) over (partition by item_id)), 6) + 0.0 as weight from x""")
def f23(t: Tables) -> DataFrame:
    ascii_only = t.benchmark.select("item_id", "text")
    return txt.tfidf(ascii_only, "item_id", "text").select("item_id", "term", r6("weight").alias("weight"))


@query("f24_text_lengths", r"select doc_id, length(text)::bigint as n_chars, len(regexp_extract_all(text, '[^ \t\n\x0b\f\r]+'))::bigint as n_tokens from documents")
def f24(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).cast("bigint").alias("n_tokens"))


@query("f25_version_suffix", "select c_custkey, c_name as gene, case when c_custkey % 3 = 0 then 'human' when c_custkey % 3 = 1 then 'mouse' else 'other' end as species from customer")
def f25(t: Tables) -> DataFrame:
    k = F.col("c_custkey") % 3
    raw = F.concat(F.when(k == 0, "hg_").when(k == 1, "mm_").otherwise("zz_"), "c_name", F.lit("."), F.col("c_custkey").cast("string"))
    x = F.col("raw")
    return t.customer.select("c_custkey", raw.alias("raw")).select("c_custkey", F.regexp_replace(F.regexp_replace(x, r"\.\d+$", ""), "^.._", "").alias("gene"), F.when(x.startswith("hg_"), "human").when(x.startswith("mm_"), "mouse").otherwise("other").alias("species"))


@query("f26_append_knowledge", "select p_partkey, rtrim(p_name) || chr(10) || 'Knowledge: ' || p_type as prompt from part")
def f26(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.concat(F.rtrim(F.concat("p_name", F.lit("  "))), F.lit("\nKnowledge: "), "p_type").alias("prompt"))


@query("f27_text_identity", "select count(distinct text)::bigint as n_texts, count(distinct sha256(text))::bigint as n_hashes, (count(distinct text) = count(distinct sha256(text))) as one_to_one from documents")
def f27(t: Tables) -> DataFrame:
    h = t.documents.select("text", F.sha2("text", 256).alias("h")).distinct()
    return h.agg(F.count("*").alias("n_texts"), F.countDistinct("h").alias("n_hashes")).withColumn("one_to_one", F.col("n_texts") == F.col("n_hashes"))


# G: numbers, arrays, JSON


@query("g01_log_normalise", "with s as (select l_orderkey, sum(l_quantity) as lib from lineitem group by 1) select l_orderkey, l_linenumber::bigint as feature, round(ln(1 + l_quantity * 10000 / lib), 6) + 0.0 as x from lineitem join s using (l_orderkey)")
def g01(t: Tables) -> DataFrame:
    s = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("lib"))
    scale = F.coalesce(col.try_ratio(F.lit(1e4), F.col("lib")), F.lit(0.0))
    return t.lineitem.join(s, "l_orderkey").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("feature"), r6(F.log1p(F.col("l_quantity") * scale)).alias("x"))


@query("g02_expm1", "select event_id, round(exp(ln(1 + abs(value))) - 1, 5) + 0.0 as x from events")
def g02(t: Tables) -> DataFrame:
    return t.events.select("event_id", (F.round(F.expm1(F.log1p(F.abs("value"))), 5) + 0.0).alias("x"))


@query("g03_log2_ratio", f"with {EFFECTS} select entity, context, feature, round(effect, 6) + 0.0 as effect from effects")
def g03(t: Tables) -> DataFrame:
    return effects(t).select("entity", "context", "feature", r6("effect").alias("effect"))


@query("g04_mean_difference", f"with {CELLS} select entity, feature, round(avg(ln(1 + value)) filter (not is_control) - avg(ln(1 + value)) filter (is_control), 6) + 0.0 as effect from cells group by all having count(*) filter (is_control) > 0 and count(*) filter (not is_control) > 0")
def g04(t: Tables) -> DataFrame:
    arm = lambda c: F.avg(F.when(c, F.log1p("value")))
    g = cells(t).groupBy("entity", "feature").agg((arm(~F.col("is_control")) - arm(F.col("is_control"))).alias("e"))
    return g.where("e is not null").select("entity", "feature", r6("e").alias("effect"))


@query("g05_normalise_policies", "select vec_id, case when vec_id % 10 = 0 then 0.0::double else 1.0::double end as zero, case when vec_id % 10 = 0 then 0.0::double else 1.0::double end as clamp, case when vec_id % 10 = 0 then null else 1.0::double end as excluded from embeddings")
def g05(t: Tables) -> DataFrame:
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(F.col("vec_id") % 10 == 0, 0.0).otherwise(x))
    e = t.embeddings.select("vec_id", v.alias("v"))
    return e.select("vec_id", *[r6(col.norm(col.unit(F.col("v"), p))).alias(n) for p, n in (("zero", "zero"), ("clamp", "clamp"), ("null", "excluded"))])


@query("g06_decimal_text", "select p_partkey, p_size::varchar as dose_nm, (p_size // 1000)::varchar || case when p_size % 1000 = 0 then '' else rtrim('.' || lpad((p_size % 1000)::varchar, 3, '0'), '0') end as dose_um from part")
def g06(t: Tables) -> DataFrame:
    um = F.col("p_size").cast("decimal(20,6)") / F.lit(1000).cast("decimal(10,0)")
    return t.part.select("p_partkey", col.decimal_text(um * F.lit(1000).cast("decimal(10,0)")).alias("dose_nm"), col.decimal_text(um).alias("dose_um"))


@query("g07_length_cost", "select a.item_id as a, b.item_id as b, round(0.5 * abs(ln((length(a.text) + 1) / (length(b.text) + 1))) + 0.5 * abs(ln((len(string_split(a.text, ' ')) + 1) / (len(string_split(b.text, ' ')) + 1))), 6) + 0.0 as cost from benchmark a, benchmark b")
def g07(t: Tables) -> DataFrame:
    b = t.benchmark.select("item_id", F.length("text").alias("n"), F.size(F.split("text", " ")).alias("w"))
    x, y = b.toDF("a", "na", "wa"), b.toDF("b", "nb", "wb")
    return x.crossJoin(y).select("a", "b", r6(col.length_cost(F.col("na"), F.col("nb")) + col.length_cost(F.col("wa"), F.col("wb"))).alias("cost"))


@query("g08_discount_table", "with r as (select distinct p_size::bigint as r from part where p_size > 0) select r, round(list_sum(list_transform(range(1, r + 1), lambda i: 1 / log2(i + 1))), 6) + 0.0 as discount, round(list_sum(list_transform(range(1, r + 1), lambda i: 1.0::double / i)), 6) + 0.0 as harmonic from r")
def g08(t: Tables) -> DataFrame:
    # cumulative discounts and harmonic numbers of the group sizes that occur
    r = t.part.where("p_size > 0").select(F.col("p_size").cast("bigint").alias("r")).distinct()
    total = lambda f: F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.col("r")), F.lit(0.0), lambda s, i: s + f(i))
    return r.select("r", r6(total(col.dcg_discount)).alias("discount"), r6(total(lambda i: 1.0 / i)).alias("harmonic"))


@query("g09_round_half_even", "select event_id, round_even(value, 1) + 0.0 as x from events")
def g09(t: Tables) -> DataFrame:
    return t.events.select("event_id", (F.bround("value", 1) + 0.0).alias("x"))


@query("g10_json_fields", """select event_id, unnest(json_keys(props)) as key, json_extract_string(props, '$.' || unnest(json_keys(props))) as value from events""")
def g10(t: Tables) -> DataFrame:
    # single quotes are repaired before parsing
    fixed = F.regexp_replace(F.regexp_replace("props", '"', "'"), "'", '"')
    return t.events.select("event_id", F.explode(F.from_json(fixed, "map<string,string>")).alias("key", "value"))


@query("g11_json_rows", """select c_nationkey::bigint as nation, '[' || string_agg('{"k":' || c_custkey || ',"s":"' || c_mktsegment || '"}', ',' order by c_custkey) || ']' as plan from customer where c_acctbal > 9500 group by 1""")
def g11(t: Tables) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("s"))))
    return t.customer.where("c_acctbal > 9500").groupBy(F.col("c_nationkey").cast("bigint").alias("nation")).agg(F.to_json(rows).alias("plan"))


@query("g12_scaled_one_hot", "select p_partkey, f as feature, round(1 / sqrt(3), 6) + 0.0 as weight from (select p_partkey, unnest(['brand=' || p_brand, 'type=' || p_type, 'size=' || p_size]) as f from part)")
def g12(t: Tables) -> DataFrame:
    f = F.array(F.concat(F.lit("brand="), "p_brand"), F.concat(F.lit("type="), "p_type"), F.concat(F.lit("size="), F.col("p_size").cast("string")))
    return t.part.select("p_partkey", F.explode(f).alias("feature"), r6(1 / F.sqrt(F.size(f))).alias("weight"))


@query("g13_field_vectors")
def g13(t: Tables) -> DataFrame:
    f = t.part.select("p_partkey", F.inline(F.array(F.struct(F.lit("brand").alias("field"), F.col("p_brand").alias("value")), F.struct(F.lit("type").alias("field"), F.col("p_type").alias("value")))))
    return kernels.field_vectors(f, "p_partkey", "field", "value", size=16).select("p_partkey", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


@query("g14_group_gaussian")
def g14(t: Tables) -> DataFrame:
    return kernels.group_gaussian(t.embeddings, "label", "vec_id", 8)


@query("g15_truncated_svd")
def g15(t: Tables) -> DataFrame:
    w = txt.tfidf(t.documents, "doc_id", "text", max_features=2_000)
    return kernels.truncated_svd(w, "doc_id", "term", "weight", 256)


@query("g16_numeric_rank")
def g16(t: Tables) -> DataFrame:
    v = t.embeddings.select("label", F.col("embedding").cast("array<double>").alias("v"))
    return kernels.numeric_rank(v.select("label", F.concat("v", F.slice("v", 1, 2)).alias("v")), "label", "v")


@query("g17_binary_fingerprints", "select p_partkey, len(list_distinct([p_size % 7, p_size % 11, p_partkey % 5]))::bigint as n_bits from part")
def g17(t: Tables) -> DataFrame:
    bits = F.array_distinct(F.array((F.col("p_size") % 7).cast("bigint"), (F.col("p_size") % 11).cast("bigint"), F.col("p_partkey") % 5))
    return t.part.select("p_partkey", F.size(bits).cast("bigint").alias("n_bits"))


@query("g18_constant_test", "select o_custkey, max(o_orderstatus = 'F')::int::bigint - min(o_orderstatus = 'F')::int::bigint <= 1e-12 as constant from orders group by 1")
def g18(t: Tables) -> DataFrame:
    x = (F.col("o_orderstatus") == "F").cast("double")
    return t.orders.groupBy("o_custkey").agg((F.max(x) - F.min(x) <= 1e-12).alias("constant"))
