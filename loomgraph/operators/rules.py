"""Rule tables of the extractors and validators."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that name a type of entity, in the order in which they are tried.
ENTITY_WORDS = [
    ("DISEASE", ("disease", "disorder", "syndrome", "condition", "illness", "pathology")),
    ("DRUG", ("drug", "medication", "medicine", "pharmaceutical", "therapeutic", "treatment")),
    ("PROTEIN", ("protein", "enzyme", "receptor", "antibody", "hormone", "kinase", "phosphatase")),
    ("GENE", ("gene", "genetic", "allele", "mutation", "variant", "polymorphism")),
    ("ANATOMY", ("organ", "tissue", "muscle", "bone", "nerve", "vessel", "gland", "organelle")),
    ("SYMPTOM", ("symptom", "sign", "manifestation", "complaint", "pain", "fever", "nausea")),
    ("PROCEDURE", ("procedure", "surgery", "operation", "treatment", "therapy", "intervention")),
    ("ORGANISM", ("bacteria", "virus", "fungus", "parasite", "microorganism", "pathogen")),
    ("CHEMICAL", ("chemical", "compound", "molecule", "substance", "element", "ion")),
    ("CELL_TYPE", ("cell", "tissue", "line", "culture", "strain")),
]

# Phrases that name a relation, in the order in which they are tried.
RELATION_PHRASES = [
    ("TREATS", "treats?|therapy|therapeutic|medication|drug|medicine"),
    ("CAUSES", "causes?|leads? to|results? in|induces?|triggers?"),
    ("ASSOCIATED_WITH", "associated with|related to|linked to|correlated with"),
    ("PREVENTS", "prevents?|protects? against|reduces? risk|avoids?"),
    ("INHIBITS", "inhibits?|suppresses?|blocks?|reduces?"),
    ("ACTIVATES", "activates?|stimulates?|enhances?|promotes?"),
    ("BINDS_TO", "binds? to|interacts? with|attaches? to|connects? to"),
    ("REGULATES", "regulates?|modulates?|controls?|influences?"),
    ("EXPRESSES", "expresses?|produces?|synthesizes?|generates?"),
    ("LOCATED_IN", "located in|found in|present in|exists in"),
    ("PART_OF", "part of|component of|constituent of|element of"),
    ("DERIVED_FROM", "derived from|originates from|comes from|stems from"),
    ("SYNONYMOUS_WITH", "synonymous with|equivalent to|same as|identical to"),
    ("CONTRAINDICATED_WITH", "contraindicated with|incompatible with|conflicts with|contradicts"),
    ("INDICATES", "indicates?|suggests?|points to|signals?"),
    ("MANIFESTS_AS", "manifests as|presents as|appears as|shows as"),
    ("ADMINISTERED_FOR", "administered for|used for|given for|prescribed for"),
    ("TARGETS", "targets?|acts on|affects?|influences?"),
    ("METABOLIZED_BY", "metabolized by|broken down by|processed by|converted by"),
    ("TRANSPORTED_BY", "transported by|carried by|moved by|transferred by"),
    ("SECRETED_BY", "secreted by|released by|produced by|generated by"),
    ("PRODUCED_BY", "produced by|manufactured by|synthesized by|created by"),
    ("CONTAINS", "contains?|includes?|has|holds"),
    ("COMPONENT_OF", "component of|constituent of|element of|part of"),
]

# Words or phrases that the head and the tail of a relation must hold; those of a relation without any take all.
ENDS = [
    ("TREATS", ("drug", "medication", "medicine", "treatment", "therapy"), ("disease", "disorder", "syndrome", "condition", "illness")),
    ("CAUSES", ("virus", "bacteria", "gene", "mutation", "factor", "condition"), ("disease", "symptom", "disorder", "syndrome", "condition")),
    ("ASSOCIATED_WITH", (), ()),
    ("PREVENTS", ("vaccine", "drug", "medication", "treatment", "prevention"), ("disease", "disorder", "syndrome", "condition", "illness")),
    ("INHIBITS", ("drug", "medication", "protein", "enzyme", "inhibitor"), ("protein", "enzyme", "receptor", "pathway", "process")),
    ("ACTIVATES", ("drug", "medication", "protein", "enzyme", "activator"), ("protein", "enzyme", "receptor", "pathway", "process")),
    ("BINDS_TO", ("drug", "medication", "protein", "ligand", "molecule"), ("receptor", "protein", "enzyme", "target", "binding site")),
    ("INTERACTS_WITH", (), ()),
    ("REGULATES", ("gene", "protein", "enzyme", "hormone", "factor"), ("gene", "protein", "enzyme", "pathway", "process")),
    ("EXPRESSES", ("gene", "genetic", "allele", "mutation"), ("protein", "enzyme", "receptor", "hormone")),
    ("LOCATED_IN", ("organ", "tissue", "cell", "protein", "molecule"), ("organ", "tissue", "cell", "compartment", "location")),
    ("PART_OF", ("component", "part", "element", "subunit"), ("organ", "tissue", "cell", "structure", "system")),
    ("DERIVED_FROM", ("protein", "molecule", "compound", "product"), ("gene", "protein", "precursor", "source")),
    ("SYNONYMOUS_WITH", (), ()),
    ("CONTRAINDICATED_WITH", ("drug", "medication", "medicine", "treatment"), ("disease", "disorder", "syndrome", "condition", "illness")),
    ("INDICATES", ("symptom", "sign", "manifestation", "marker"), ("disease", "disorder", "syndrome", "condition", "illness")),
    ("MANIFESTS_AS", ("disease", "disorder", "syndrome", "condition", "illness"), ("symptom", "sign", "manifestation", "presentation")),
    ("ADMINISTERED_FOR", ("drug", "medication", "medicine", "treatment"), ("disease", "disorder", "syndrome", "condition", "illness")),
    ("TARGETS", ("drug", "medication", "medicine", "treatment"), ("protein", "enzyme", "receptor", "pathway", "process")),
    ("METABOLIZED_BY", ("drug", "medication", "medicine", "compound"), ("enzyme", "protein", "cytochrome", "metabolizing")),
    ("TRANSPORTED_BY", ("molecule", "compound", "drug", "medication"), ("transporter", "protein", "carrier", "pump")),
    ("SECRETED_BY", ("hormone", "protein", "enzyme", "molecule"), ("gland", "organ", "tissue", "cell", "secretory")),
    ("PRODUCED_BY", ("protein", "hormone", "enzyme", "molecule"), ("gene", "cell", "tissue", "organ", "producer")),
    ("CONTAINS", ("organ", "tissue", "cell", "compartment", "structure"), ("component", "part", "element", "molecule", "protein")),
    ("COMPONENT_OF", ("component", "part", "element", "subunit", "molecule"), ("organ", "tissue", "cell", "structure", "system")),
]
# Further names of relations that are known; they take all ends.
OPEN_RELATIONS = [
    "CREATED_BY", "WORKED_AT", "BORN_IN", "DIED_IN", "FOUNDED", "LED", "INFLUENCED", "DEVELOPED", "INVENTED", "DISCOVERED", "WROTE", "PAINTED", "COMPOSED", "DIRECTED", "ACTED_IN",
    "OCCURRED_IN", "HAPPENED_DURING", "PART_OF_EVENT", "RELATED_TO", "SIMILAR_TO", "OPPOSITE_OF", "PRECEDED_BY", "FOLLOWED_BY",
]

# Keywords of a relation that support a triple; other relations stand for their own name.
KEYWORDS = {
    "TREATS": ["treat", "treatment", "therapy", "medication", "drug"],
    "CAUSES": ["cause", "lead to", "result in", "induce", "produce"],
    "ASSOCIATED_WITH": ["associated", "related", "linked", "connected", "correlated"],
    "INDICATES": ["indicate", "suggest", "show", "demonstrate", "reveal"],
    "PREVENTS": ["prevent", "protect", "block", "inhibit", "reduce"],
    "COMPLICATES": ["complicate", "worsen", "exacerbate", "aggravate"],
}

# Semantic types that a relation allows for its head and its tail; "*" is any.
COMPATIBLE = {
    "TREATS": (["Disease", "Pharmacologic Substance"], ["Disease"]),
    "CAUSES": (["Disease", "Finding"], ["Disease", "Finding"]),
    "ASSOCIATED_WITH": (["*"], ["*"]),
    "INDICATES": (["Finding", "Laboratory Procedure"], ["Disease", "Finding"]),
    "PREVENTS": (["Pharmacologic Substance", "Therapeutic Procedure"], ["Disease"]),
}

# Properties of a public knowledge base and the relations that they mean; others are RELATED_TO.
PROPERTIES = {
    "P569": "BORN_IN", "P570": "DIED_IN", "P19": "BORN_IN", "P20": "DIED_IN", "P108": "WORKED_AT", "P102": "WORKED_AT",
    "P57": "DIRECTED", "P86": "COMPOSED", "P170": "CREATED_BY", "P50": "AUTHOR", "P136": "CREATED_BY",
    "P131": "LOCATED_IN", "P276": "LOCATED_IN", "P112": "FOUNDED", "P159": "LOCATED_IN",
    "P585": "OCCURRED_IN", "P580": "PRECEDED_BY", "P582": "FOLLOWED_BY", "P737": "INFLUENCED", "P61": "DISCOVERED",
    "P31": "RELATED_TO", "P279": "RELATED_TO",
}

# Patterns of general entities, in order.
GENERAL = [
    ("PERSON", r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2}"),
    ("LOCATION", r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?\s+(?:City|Town|Village|State|Country|Kingdom|Empire|Palace|Castle)"),
    ("ORGANIZATION", r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?\s+(?:University|College|Corporation|Company|Foundation|Institute|Museum)"),
    ("DATE", r"(?:\d{1,2}[/-])?\d{1,2}[/-]\d{2,4}|(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}"),
    ("NUMBER", r"\d+(?:,\d{3})*(?:\.\d+)?\s*(?:years?|days?|months?|centuries?)?"),
]

SPECIFIC = ("specific", "precise", "exact", "definitive")
DOMAIN = ("medical", "clinical", "biomedical", "scientific")


def any_word(words: tuple[str, ...]) -> str:
    """A pattern of texts that hold one of the words or phrases, as whole words; letters of all scripts count."""
    return r"(?:^|[^\p{L}\p{N}_])(?:" + "|".join(words) + r")(?:$|[^\p{L}\p{N}_])"


def any_phrase(phrases: str) -> str:
    return rf"\b(?:{phrases})\b"


def entity_type(text: Column) -> Column:
    """The first type one of whose words a name holds (CLS-1)."""
    out, low = F.lit("UNKNOWN"), F.lower(text)
    for kind, words in reversed(ENTITY_WORDS):
        out = F.when(low.rlike(any_word(words)), kind).otherwise(out)
    return out


def stems(phrases: str) -> list[str]:
    """Of each of the phrases the longest piece that any text with it holds."""
    return list(dict.fromkeys(max(re.split(r".\?", p), key=len) for p in phrases.split("|")))


def _holds(low: Column, stems_: list[str], pattern: str) -> Column:
    """low.rlike(pattern), sought only in texts that hold a stem: a plain search costs a small part of a pattern's."""
    return reduce(lambda a, b: a | b, [low.contains(w) for w in stems_]) & low.rlike(pattern)


def _case(branches: list[tuple[Column, Column | str]], otherwise: Column) -> Column:
    """One CASE of all branches, not one in the other: what its conditions share is made once for a row."""
    first, *rest = branches
    out = F.when(*first)
    for on, value in rest:
        out = out.when(on, value)
    return out.otherwise(otherwise)


def relation_type(context: Column) -> Column:
    """The first relation one of whose phrases a context holds (CLS-2)."""
    low = F.lower(context)
    return _case([(_holds(low, stems(p), any_phrase(p)), F.lit(kind)) for kind, p in RELATION_PHRASES], F.lit("UNKNOWN_RELATION"))


def known_type(name: Column, kinds: list[str], unknown: str) -> Column:
    """A type's name in upper case if it is known (CLS-3)."""
    up = F.upper(F.trim(name))
    return F.when(up.isin(*kinds), up).otherwise(unknown)


def valid_entity(text: Column, kind: Column) -> Column:
    """2 to 200 characters and, for a type with words, one of them (VAL-1)."""
    ok = F.lit(True)
    for k, words in ENTITY_WORDS:
        ok = F.when(kind == k, F.lower(text).rlike(any_word(words))).otherwise(ok)
    return F.length(text).between(2, 200) & ok


def valid_relation(head: Column, kind: Column, tail: Column, strict: bool = True) -> Column:
    """Ends that differ, are not empty and hold their words (VAL-2, VAL-3).

    Strict, an unknown relation takes any ends. Not strict, it takes none, and
    known ones also take ends that are longer than one character.
    """
    ok = F.lit(True)
    for k, h, t in ENDS:
        if h:
            ok = F.when(kind == k, F.lower(head).rlike(any_word(h)) & F.lower(tail).rlike(any_word(t))).otherwise(ok)
    if not strict:
        known = F.upper(kind).isin([k for k, _, _ in ENDS] + OPEN_RELATIONS)
        ok = known & (ok | ((F.length(head) > 1) & (F.length(tail) > 1)))
    return (head != "") & (tail != "") & (head != tail) & ok


def _add(base: Column, *steps: tuple[Column, float]) -> Column:
    """Bonuses in order: sums of doubles depend on it."""
    for on, bonus in steps:
        base = base + F.when(on, bonus).otherwise(0.0)
    return base


def entity_confidence(text: Column, kind: Column) -> Column:
    """CONF-1 of domain entities."""
    n, low = F.length(text), F.lower(text)
    size = F.when(n.between(5, 50), 0.2).when(n.between(3, 100), 0.1).otherwise(0.0)
    score = _add(F.lit(0.5) + size, (low.rlike(any_word(SPECIFIC)), 0.1), ((kind != "UNKNOWN") & low.rlike(any_word(DOMAIN)), 0.1))
    return F.when(valid_entity(text, kind), F.least(score, F.lit(1.0))).otherwise(0.0)


def relation_confidence(head: Column, kind: Column, tail: Column, context: Column) -> Column:
    """CONF-2 of domain relations; 0.3 for unknown ones."""
    low = F.lower(context)
    score = _add(F.lit(0.5), (context != "", 0.2), (F.length(head).between(3, 50) & F.length(tail).between(3, 50), 0.1), (_holds(low, list(SPECIFIC), any_word(SPECIFIC)), 0.1), (_holds(low, list(DOMAIN), any_word(DOMAIN)), 0.1))
    return F.when(kind == "UNKNOWN_RELATION", 0.3).when(valid_relation(head, kind, tail), F.least(score, F.lit(1.0))).otherwise(0.0)


def name_confidence(text: Column, kind: Column) -> Column:
    """CONF-1 of general entities."""
    n = F.length(text)
    size = F.when(n.between(3, 30), 0.15).when((n > 30) & (n <= 60), 0.1).when((n > 60) & (n <= 100), 0.05).otherwise(0.0)
    place = kind.isin("LOCATION", "COUNTRY", "CITY")
    score = _add(
        F.lit(0.55) + size,
        (text.rlike(r"^\p{Lu}"), 0.1),
        ((kind == "PERSON") & text.contains(" "), 0.15),
        ((kind == "PERSON") & text.rlike(r"(Louis|Henry|Charles|Francis|Philip|Marie|Anne|Margaret)\b"), 0.1),
        ((kind == "ORGANIZATION") & text.rlike("University|College|Corp|Inc|Ltd|Company|Bourbon|Valois|Capetian"), 0.15),
        (place & text.rlike("City|Town|Country|Island|Mountain|River|Palace|Château"), 0.15),
        (place & text.isin("France", "Paris", "Versailles", "London", "Spain", "Austria"), 0.15),
        (kind.isin("EVENT", "TITLE"), 0.15),
    )
    return F.when(text == "", 0.0).when(kind == "CONCEPT", 0.35).otherwise(F.least(score, F.lit(1.0)))


def compatible(head_types: Column, kind: Column, tail_types: Column) -> Column:
    """Whether types may stand at the ends of a relation; unknown relations take none (VAL-4)."""
    out = F.lit(False)
    for k, (heads, tails) in COMPATIBLE.items():
        side = lambda types, allowed: F.lit(True) if "*" in allowed else F.arrays_overlap(types, F.array(*map(F.lit, allowed)))
        out = F.when(kind == k, side(head_types, heads) & side(tail_types, tails)).otherwise(out)
    return out


def supported(head: Column, kind: Column, tail: Column, context: Column) -> Column:
    """Both ends and a keyword of the relation in the context (EVAL-1)."""
    low = F.lower(context)
    any_of = lambda words: reduce(lambda a, b: a | b, [low.contains(w) for w in words])
    keyword = _case([(kind == k, any_of(words)) for k, words in KEYWORDS.items()], low.contains(F.lower(kind)))
    return low.contains(F.lower(head)) & low.contains(F.lower(tail)) & keyword


def validity(head_type: Column, kind: Column, tail_type: Column) -> Column:
    """yes, maybe or no by the types of the ends (EVAL-4)."""
    h, k, t = F.lower(head_type), F.lower(kind), F.lower(tail_type)
    return F.when((k == "treats") & (h == "drug") & (t == "disease"), "yes").when((k == "causes") & (h == "disease") & (t == "disease"), "yes").when(k == "associated_with", "maybe").otherwise("no")


def property_relation(name: Column) -> Column:
    """The relation that a knowledge-base property means (JOIN-19)."""
    known = F.create_map(*(F.lit(x) for p in PROPERTIES.items() for x in p))
    return F.coalesce(F.element_at(known, name), F.lit("RELATED_TO"))


def wilson(share: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """The Wilson interval of a share among n (CONF-4); (0, 0) without any."""
    mid = (share + z**2 / (2 * n)) / (1 + z**2 / n)
    half = z * F.sqrt(share * (1 - share) / n + z**2 / (4 * n * n)) / (1 + z**2 / n)
    none = (n == 0) | n.isNull()
    return F.when(none, 0.0).otherwise(F.greatest(F.lit(0.0), mid - half)), F.when(none, 0.0).otherwise(F.least(F.lit(1.0), mid + half))


# Relations that texts of no domain may have.
PLAIN_RELATIONS = ["ASSOCIATED_WITH", "MARRIED_TO", "PARENT_OF", "LOCATED_IN", "REIGNED", "IS_OF"]


def plain_entity(text: Column, kind: Column) -> Column:
    """Whether a name is long enough to be one, whatever its type (UDF-1)."""
    return F.length(text) >= 2


def plain_relation(head: Column, kind: Column, tail: Column) -> Column:
    """Whether a relation is of a kind that texts of no domain may have (UDF-1)."""
    return kind.isin(*PLAIN_RELATIONS) | F.startswith(kind, F.lit("RELATED"))
