"""More registered queries: whole jobs and rules over derived tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspan.functions import text as shape
from veilspan.functions import validators
from veilspan.operators import evaluate, overlap, policy, recognizers, surrogates, vocabulary
from veilspan.plans import redaction
from veilspan.plans.queries import _MASK, _email_sql, _match_sql, _pool, _scored_sides, query, t

# -- detection and policy ------------------------------------------------------------------------

_IBAN = "concat('pay to GB', lpad(cast(c_custkey % 97 as string), 2, '0'), ' WEST ', lpad(cast(c_custkey * 7 % 10000 as string), 4, '0'), ' ', lpad(cast(c_custkey * 31 % 10000 as string), 4, '0'), ' ', lpad(cast(c_custkey * 13 % 10000 as string), 4, '0'), ' ', lpad(cast(c_custkey * 3 % 100 as string), 2, '0'), ' today')"


@query(f"""WITH x AS (SELECT c_custkey, {_IBAN} AS text FROM customer), y AS (SELECT c_custkey, substr(text, 8, 27) AS span FROM x)
    SELECT c_custkey, 7::INT AS "start", 34::INT AS "end", span FROM y WHERE CAST('32142829' || replace(substr(span, 11, 17), ' ', '') || '1611' || substr(span, 3, 2) AS HUGEINT) % 97 = 1""")
def iban_spans(spark, sf_dir):
    """Account numbers that pass mod 97, every second digit pair but one in 97 failing."""
    texts = t(spark, sf_dir, "customer").select("c_custkey", F.expr(_IBAN).alias("text"))
    found = recognizers.detect(texts, keys=("c_custkey",), wanted=("IBAN_CODE",))
    return found.select("c_custkey", "start", "end", F.col("text").alias("span"))


_TYPED = "case c_custkey % 6 when 0 then 'IN_IFSC' when 1 then 'IN_PASSPORT' when 2 then 'IN_VOTER_ID' when 3 then 'IN_MOBILE' when 4 then 'IP_ADDRESS' else 'PERSON' end"
_VALUE = "case c_custkey % 6 when 0 then concat('HDFC', cast(c_custkey % 2 as string), lpad(cast(c_custkey as string), 6, '0')) when 1 then concat(substring('AQRZ', cast(1 + c_custkey % 4 as int), 1), lpad(cast(c_custkey as string), 7, '0')) when 2 then concat('ABC', lpad(cast(c_custkey as string), cast(6 + c_custkey % 3 as int), '0')) when 3 then cast(5500000000 + c_custkey * 1000000 as string) when 4 then concat('10.1.', cast(c_custkey % 400 as string), '.7') else 'Ada Quill' end"


@query(f"""SELECT c_custkey, CASE ty WHEN 'IN_IFSC' THEN regexp_full_match(x, '[A-Z]{{4}}0[0-9A-Z]{{6}}') WHEN 'IN_PASSPORT' THEN regexp_full_match(x, '[A-PR-WY][0-9]{{7}}') WHEN 'IN_VOTER_ID' THEN regexp_full_match(x, '[A-Z]{{3}}[0-9]{{7}}')
    WHEN 'IN_MOBILE' THEN regexp_full_match(x, '[6-9][0-9]{{9}}') WHEN 'IP_ADDRESS' THEN CAST(string_split(x, '.')[3] AS INT) < 256 END AS valid FROM (SELECT c_custkey, {_TYPED} AS ty, {_VALUE} AS x FROM customer)""")
def typed_validity(spark, sf_dir):
    """Each value by its type's validator, and NULL for a type without one (V9)."""
    return t(spark, sf_dir, "customer").select("c_custkey", validators.is_valid(F.expr(_TYPED), F.expr(_VALUE)).alias("valid"))


_EDGE_TYPE = "case p_partkey % 4 when 0 then 'PERSON' when 1 then 'IP_ADDRESS' when 2 then 'EMAIL_ADDRESS' else 'BANK_ACCOUNT' end"
_EDGE_TEXT = "case cast(p_partkey / 4 as int) % 5 when 0 then '  ' when 1 then 'Zq' when 2 then '9' when 3 then 'u@h.example.org 1' else 'Ada Quill' end"


@query(f"""SELECT p_partkey, CASE WHEN trim(x) = '' THEN 'empty' WHEN ty IN ('IP_ADDRESS', 'BANK_ACCOUNT') AND NOT regexp_matches(x, '[0-9]') OR ty = 'EMAIL_ADDRESS' AND NOT contains(x, '@') THEN 'not shaped like its type'
    WHEN ty IN ('IP_ADDRESS', 'EMAIL_ADDRESS') THEN 'redacted' WHEN length(trim(x)) < 3 THEN 'too short' WHEN p_partkey % 4 = 0 AND contains(x, '@') THEN 'malformed' ELSE 'redacted' END AS decision
    FROM (SELECT p_partkey, {_EDGE_TYPE.replace('p_partkey / 4', 'floor(p_partkey / 4)')} AS ty, {_EDGE_TEXT.replace('p_partkey / 4', 'floor(p_partkey / 4)')} AS x FROM part) WHERE NOT (ty IN ('PERSON', 'BANK_ACCOUNT') AND contains(x, '@'))""")
def policy_edges(spark, sf_dir):
    """Empty spans, types that are always private, and short spans, in the order of the rules."""
    rows = t(spark, sf_dir, "part").select("p_partkey", F.expr(_EDGE_TYPE).alias("ty"), F.expr(_EDGE_TEXT.replace("p_partkey / 4", "floor(p_partkey / 4)")).alias("x"))
    rows = rows.where(~(F.col("ty").isin("PERSON", "BANK_ACCOUNT") & F.contains("x", F.lit("@"))))
    return rows.select("p_partkey", F.coalesce(policy.decision(F.col("ty"), F.col("x")), F.lit("redacted")).alias("decision"))


_MERGED_TYPE = "case p_partkey % 3 when 0 then 'LOCATION' when 1 then 'ORGANIZATION' else 'EMAIL_ADDRESS' end"
_MERGED_TEXT = "case p_size % 4 when 0 then 'Pune' when 1 then 'Plot 7, Pune' when 2 then 'The value of the offer and of the share' else 'Zenith Harbour Cedar Limited' end"


@query(f"""SELECT p_partkey, CASE WHEN ty = 'LOCATION' AND NOT regexp_matches(x, '[0-9]') AND len(string_split(x, ' ')) <= 3 THEN 'bare place name'
    WHEN ty <> 'EMAIL_ADDRESS' AND len(list_filter(string_split(x, ' '), lambda w: regexp_matches(w, '^[a-z]'))) / len(string_split(x, ' ')) > {policy.PROSE_SHARE} THEN 'prose, after merge' ELSE 'redacted' END AS decision
    FROM (SELECT p_partkey, {_MERGED_TYPE} AS ty, {_MERGED_TEXT} AS x FROM part)""")
def merged_decisions(spark, sf_dir):
    """What is kept after spans were merged: bare places and prose, structured types excepted."""
    ty, x = F.expr(_MERGED_TYPE), F.expr(_MERGED_TEXT)
    return t(spark, sf_dir, "part").select("p_partkey", F.coalesce(policy.after_merge(ty, x, ty.isin(*recognizers.STRUCTURED)), F.lit("redacted")).alias("decision"))


_PROSE_LINES = "array('Intro: not a definition here', 'Definitions and Abbreviations', concat(n_name, ' means a country'), concat('Code ', cast(n_nationkey as string), ': see the list'), 'plain line without a sign', 'THE NEXT PART', 'Late: not learnt')"


@query("SELECT n_nationkey AS doc_id, 'term' AS kind, lower(n_name) AS phrase FROM nation UNION ALL SELECT n_nationkey, 'term', 'code ' || n_nationkey::VARCHAR FROM nation")
def prose_glossary(spark, sf_dir):
    """Definitions line by line under a glossary heading, up to a heading in capitals."""
    blocks = t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), F.posexplode(F.expr(_PROSE_LINES)).alias("block_no", "text"))
    return vocabulary.learn_prose(blocks).select("doc_id", "kind", "phrase")


# -- stand-ins -----------------------------------------------------------------------------------


@query("SELECT s_suppkey, 's' || (s_suppkey + 1)::VARCHAR AS key, CASE WHEN s_suppkey % 2 = 0 THEN 'chief ' ELSE 'agent ' END || s_suppkey::VARCHAR AS owner FROM supplier UNION ALL SELECT s_suppkey, 'x' || (s_suppkey + 1)::VARCHAR, CASE WHEN s_suppkey % 2 = 0 THEN 'chief ' ELSE 'agent ' END || s_suppkey::VARCHAR FROM supplier")
def alias_map(spark, sf_dir):
    """Aliases have their canonical's stand-in; the last one wins and chains are followed."""
    rows = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"))
    names = F.array(F.concat(F.lit("Agent "), "doc_id"), F.concat(F.lit("Chief "), "doc_id"), F.concat(F.lit("S"), F.col("doc_id") + 1))
    entities = rows.select("doc_id", F.lit("PERSON").alias("entity_type"), F.posexplode(names).alias("start", "text"))
    mapped = surrogates.mapping(entities, types=("PERSON",))
    short, other = F.concat(F.lit("S"), F.col("doc_id") + 1), F.concat(F.lit("X"), F.col("doc_id") + 1)
    link = lambda v, c, turn: F.struct(v.alias("variant"), c.alias("canonical"), F.lit(turn).alias("turn"))
    links = F.array(link(other, short, 0), link(short, names[0], 1), F.when(F.col("doc_id") % 2 == 0, link(short, names[1], 2)))
    aliases = rows.select("doc_id", F.explode(links).alias("a")).where("a IS NOT NULL").select("doc_id", "a.*")
    done = surrogates.with_aliases(mapped, aliases)
    owners = done.where("not is_alias").select("doc_id", "surrogate", F.col("key").alias("owner"))
    return done.where("is_alias").join(owners, ["doc_id", "surrogate"]).select(F.col("doc_id").alias("s_suppkey"), "key", "owner")


@query("SELECT entity_type, count(*) AS keys, count(*) AS surrogates, 0::BIGINT AS numbered FROM (SELECT unnest(['PERSON', 'IP_ADDRESS']) AS entity_type, c_custkey FROM customer) GROUP BY entity_type")
def surrogate_uniqueness(spark, sf_dir):
    """Every customer's name and address in one scope: no two share a stand-in, none falls back to a number."""
    kinds = F.array(F.struct(F.lit("PERSON").alias("entity_type"), F.concat(F.lit("Customer Number "), "c_custkey").alias("text")), F.struct(F.lit("IP_ADDRESS").alias("entity_type"), F.concat_ws(".", F.lit("10"), F.floor(F.col("c_custkey") / 65536).cast("int"), F.floor(F.col("c_custkey") / 256).cast("int") % 256, F.col("c_custkey") % 256).alias("text")))
    rows = t(spark, sf_dir, "customer").select(F.lit(1).alias("doc_id"), F.col("c_custkey").alias("start"), F.explode(kinds).alias("x")).select("doc_id", "start", "x.*")
    mapped = surrogates.mapping(rows, types=("PERSON", "IP_ADDRESS"))
    return mapped.groupBy("entity_type").agg(F.count("*").alias("keys"), F.countDistinct("surrogate").alias("surrogates"), F.count_if(F.col("surrogate").rlike(r" \d+$")).alias("numbered"))


# -- the whole job -------------------------------------------------------------------------------

_MAIL = "concat('u', cast(c_custkey % 700 as string), '@corp.example.org')"
_MIXED_ID = "case when c_custkey % 5 = 0 then null else cast(c_custkey % 50 as string) end"


@query(f"""SELECT doc_id, 'from ' || {_email_sql('m')} || ' to ' || {_email_sql('m')} || '.' AS text, 2::INT AS replacements FROM (SELECT {_MIXED_ID} AS doc_id, {_MAIL} AS m FROM customer)""")
def redact_mixed_ids(spark, sf_dir):
    """The whole job over rows whose ids are null, repeated and text: detection, policy, overlaps, mapping, rewriting."""
    rows = t(spark, sf_dir, "customer").select(F.expr(_MIXED_ID).alias("doc_id"), F.expr(f"concat('from ', {_MAIL}, ' to ', upper({_MAIL}), '.')").alias("text"))
    return redaction.redact(rows, redaction.Config(wanted=("EMAIL_ADDRESS",)))


_PARTY = "concat(case c_custkey % 5 when 0 then 'Rolf' when 1 then 'Ida' when 2 then 'Edwin' when 3 then 'Clara' else 'Hugo' end, ' ', case c_custkey % 7 when 0 then 'Amberson' when 1 then 'Quill' when 2 then 'Hartwig' when 3 then 'Lindqvist' when 4 then 'Marlowe' when 5 then 'Pettigrew' else 'Sandoval' end)"
_LETTER = f"concat('Paid to Mr. ', {_PARTY}, ', mail ', {_MAIL}, ', Order No. 4819 stays. ', upper({_PARTY}), ' agreed.')"
_PERSON = "'PERSON:' || lower(n)"


@query(f"""SELECT c_custkey AS doc_id, 'Paid to Mr. ' || p || ', mail ' || {_email_sql('m')} || ', Order No. 4819 stays. ' || p || ' agreed.' AS text, 3::INT AS replacements
    FROM (SELECT c_custkey, m, {_pool(surrogates.GIVEN, 0, _PERSON)} || ' ' || {_pool(surrogates.FAMILY, 1, _PERSON)} AS p FROM (SELECT c_custkey, {_MAIL} AS m, {_PARTY} AS n FROM customer))""")
def redact_letters(spark, sf_dir):
    """The whole job over letters with a name, its mention in capitals and an address: what is private goes, the same way each time, the rest stays."""
    rows = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.expr(_LETTER).alias("text"))
    return redaction.redact(rows, redaction.Config(recognizers=(*recognizers.DEFAULT, *recognizers.NAME_RULES)))


# -- evaluation ----------------------------------------------------------------------------------

_INSIDE = "WHERE e > s AND s >= 500 AND e <= 2500"


@query(f"{_match_sql('relaxed').replace('WHERE e > s)', _INSIDE + ')')} SELECT entity_type, tp, fp, fn FROM k")
def score_in_region(spark, sf_dir):
    """Scores of what lies within a region of each document."""
    return evaluate.per_type(evaluate.matched(*_scored_sides(spark, sf_dir), "relaxed", region=(500, 2500)))


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size::VARCHAR || '–' || (p_size + 9)::VARCHAR ELSE {_MASK.format(x='p_name')} END AS shown FROM part")
def described_spans(spark, sf_dir):
    """A value's mask, or its offsets where the value is not at hand."""
    known = F.when(F.col("p_partkey") % 3 != 0, F.col("p_name"))
    return t(spark, sf_dir, "part").select("p_partkey", evaluate.described(known, F.col("p_size"), F.col("p_size") + 9).alias("shown"))


_SHOUT = "concat('Signed by ', upper(p_name), ' here')"


@query(f"SELECT p_partkey, 'Signed by ' || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') || ' here' AS text FROM part WHERE len(string_split(p_name, ' ')) >= 3")
def truecased_names(spark, sf_dir):
    """Three and more words in capitals read in title case."""
    rows = t(spark, sf_dir, "part").where(shape.word_count(F.col("p_name")) >= 3)
    none = F.array().cast("array<struct<start:int,end:int>>")
    return rows.select("p_partkey", vocabulary.truecased(F.expr(_SHOUT), none).alias("text"))


@query("""WITH n AS (SELECT n_nationkey, lower(n_name) AS a, lower(n_name) || ' trading house' AS b FROM nation)
    SELECT n_nationkey, a AS variant, b AS canonical FROM n UNION ALL SELECT n_nationkey, 'trading house', b FROM n""")
def name_variants(spark, sf_dir):
    """Variants of a name point at the longest that holds them word by word, whatever their case."""
    forms = F.array(F.col("n_name"), F.concat("n_name", F.lit("  Trading HOUSE")), F.lit("Trading House"), F.concat("n_name", F.lit("ia")))
    rows = t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), F.lit("ORGANIZATION").alias("entity_type"), F.explode(forms).alias("text"))
    return overlap.canonical_names(rows).select(F.col("doc_id").alias("n_nationkey"), "variant", "canonical")


