"""Each relation's validator, by ends that it alone accepts or refuses; models that fail."""

import pytest
from loomgraph import domains
from loomgraph.operators import rules as R
from pyspark.sql import functions as F

# relation, a head and a tail that it takes, a head that it refuses with that tail, a tail that it refuses with that head
CASES = [
    ("TREATS", "a therapy", "an illness", "a vaccine", "a symptom"),
    ("CAUSES", "some bacteria", "a symptom", "a drug", "an illness"),
    ("PREVENTS", "a vaccine", "an illness", "a therapy", "a symptom"),
    ("INHIBITS", "the inhibitor", "a pathway", "the activator", "a hormone"),
    ("ACTIVATES", "the activator", "a pathway", "the inhibitor", "a hormone"),
    ("BINDS_TO", "a ligand", "the binding site", "a hormone", "a web site"),
    ("REGULATES", "a factor", "a gene", "a drug", "a receptor"),
    ("EXPRESSES", "an allele", "a hormone", "a protein", "a process"),
    ("LOCATED_IN", "a molecule", "the compartment", "a hormone", "a system"),
    ("PART_OF", "a subunit", "the system", "a molecule", "a compartment"),
    ("DERIVED_FROM", "the product", "a precursor", "a hormone", "a cell"),
    ("CONTRAINDICATED_WITH", "a medicine", "the syndrome", "a therapy", "a symptom"),
    ("INDICATES", "the marker", "the syndrome", "a drug", "a symptom"),
    ("MANIFESTS_AS", "the syndrome", "a presentation", "a symptom", "an illness"),
    ("ADMINISTERED_FOR", "a treatment", "a condition", "a vaccine", "a symptom"),
    ("TARGETS", "a medicine", "a receptor", "a therapy", "a hormone"),
    ("METABOLIZED_BY", "a compound", "the cytochrome", "a treatment", "a receptor"),
    ("TRANSPORTED_BY", "a molecule", "a pump", "a hormone", "an enzyme"),
    ("SECRETED_BY", "a hormone", "a gland", "a gene", "a gene"),
    ("PRODUCED_BY", "a hormone", "the producer", "a gene", "a gland"),
    ("CONTAINS", "a compartment", "a molecule", "a system", "a gene"),
    ("COMPONENT_OF", "a molecule", "the structure", "a protein", "a compartment"),
]


def test_each_validator(spark):
    rows = [(k, h, t, want) for k, head, tail, no_head, no_tail in CASES for h, t, want in ((head, tail, True), (no_head, tail, False), (head, no_tail, False))]
    rows += [(k, "anything", "else", True) for k in ("ASSOCIATED_WITH", "INTERACTS_WITH", "SYNONYMOUS_WITH", "UNKNOWN_RELATION")]
    rows += [(k, "same", "same", False) for k, *_ in R.ENDS] + [(k, "", "x", False) for k, *_ in R.ENDS]
    df = spark.createDataFrame(rows, "kind string, head string, tail string, want boolean")
    wrong = df.where(R.valid_relation(F.col("head"), F.col("kind"), F.col("tail")) != F.col("want")).collect()
    assert wrong == []
    assert len(R.ENDS) == 25 and {k for k, *_ in CASES} == {k for k, h, _ in R.ENDS if h}


def test_words_are_whole_and_of_any_script(spark):
    df = spark.createDataFrame([("organ", True), ("an organ.", True), ("organs", False), ("éorgan", False), ("organé", False), ("organ-cell", True), ("x_organ", False), ("ORGAN", True)], "t string, want boolean")
    assert df.where(F.lower("t").rlike(R.any_word(("organ",))) != F.col("want")).collect() == []


def test_lenient_rules_know_relations(spark):
    one = spark.range(1).select(
        R.valid_relation(F.lit("ab"), F.lit("CONTAINS"), F.lit("cd"), strict=False).alias("long"),
        R.valid_relation(F.lit("a"), F.lit("CONTAINS"), F.lit("cd"), strict=False).alias("short"),
        R.valid_relation(F.lit("ab"), F.lit("wrote"), F.lit("cd"), strict=False).alias("named"),
        R.valid_relation(F.lit("ab"), F.lit("NO_SUCH"), F.lit("cd"), strict=False).alias("unknown"),
    ).first()
    assert one.asDict() == {"long": True, "short": False, "named": True, "unknown": False}


@pytest.fixture
def one_by_one(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


TEXTS = [(k, f"Alpha Beta disease met Gamma Delta {k}") for k in range(10)]


def backend(folder, fails):
    def open_():
        def run(prompts):
            for p in prompts:
                with open(f"{folder}/calls", "a") as f:
                    f.write(p.rpartition(" ")[2] + "\n")
            if fails(sum(1 for _ in open(f"{folder}/calls"))):
                raise RuntimeError("busy")
            return ["1. Gamma Delta"] * len(prompts)

        return run

    return open_


def test_a_model_is_asked_once_a_text(spark, tmp_path, one_by_one):
    docs = spark.createDataFrame(TEXTS, "k long, text string").coalesce(1)
    got = domains.CLINICAL.model_entities(docs, "k", backend(tmp_path, lambda n: False)).collect()
    assert sorted(int(x) for x in open(f"{tmp_path}/calls")) == list(range(10))
    assert {(r.k, r.text, r.by) for r in got} == {(k, "Gamma Delta", "model") for k in range(10)}


def test_a_flaky_model_loses_no_text(spark, tmp_path, one_by_one):
    docs = spark.createDataFrame(TEXTS, "k long, text string").coalesce(1)
    got = domains.CLINICAL.model_entities(docs, "k", backend(tmp_path, lambda n: n % 2 == 0)).collect()
    assert sorted(int(x) for x in open(f"{tmp_path}/calls")) == list(range(10))
    by = {k: {(r.text, r.by) for r in got if r.k == k} for k in range(10)}
    assert sorted(map(sorted, by.values())) == [[("Alpha Beta disease", "rule")]] * 5 + [[("Gamma Delta", "model")]] * 5
    rule = next(r for r in got if r.by == "rule")
    assert (rule.type, rule.start, rule.stop) == ("DISEASE", 1, 18)
