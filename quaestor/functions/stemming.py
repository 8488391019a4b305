"""French stems (the published Snowball algorithm) as expressions over a vocabulary table.

The job runs on *distinct* words: ``with_stems`` adds a column to a table of
words, and texts are joined to it on the word. Words are accent-free, so the
accented endings of the algorithm never occur and are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Vowels and endings of the algorithm.
VOWELS = "aeiouy"
STEP_1_ENDINGS = (
    "ances? iqUes? ismes? ables? istes? eux atrices? ateurs? ations? logies? usions? utions? ences? ements? "
    "ifs? ives? eaux aux euses? issements? amment emment ments?"
).split()
I_VERB_ENDINGS = (
    "i ie Ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait "
    "issant issante issantes issants isse issent isses issez issiez issions issons it"
).split()
PLAIN_VERB_ENDINGS = (
    "er era erai eraIent erais erait eras erez eriez erions erons eront ez iez"
).split()
A_VERB_ENDINGS = "a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split()

_V = f"[{VOWELS}]"
_C = f"[^{VOWELS}]"


def _ending(word: Column, endings: list[str]) -> Column:
    """The longest of the endings the word has, or ''."""
    return F.regexp_extract(word, f"(?:{'|'.join(endings)})$", 0)


def _without(word: Column, ending: Column | int) -> Column:
    cut = F.lit(ending) if isinstance(ending, int) else F.length(ending)
    return F.substring(word, F.lit(1), F.length(word) - cut)


def _marked(word: Column) -> Column:
    """Vowels that act as consonants are upper case from here on."""
    pairs = F.regexp_replace(word, f"({_V}(?:[ui](?={_V})|y)|y(?={_V})|qu)", "$1\u0001")
    for letter in "uiy":
        pairs = F.replace(pairs, F.lit(f"{letter}\u0001"), F.lit(letter.upper()))
    return pairs


def _region_start(word: Column, pattern: str) -> Column:
    found = F.length(F.regexp_extract(word, pattern, 0))
    return F.when(found > 0, found).otherwise(F.length(word))


def _standard_suffix(w: Column, ending: Column) -> tuple[Column, Column]:
    """(result when the step applies, rewritten word when it rewrites but the verb steps still run)."""
    base = _without(w, ending)
    start = F.length(base)
    p1, p2, pv = F.col("_p1"), F.col("_p2"), F.col("_pv")
    one, two, verb = start >= p1, start >= p2, start >= pv

    def in_r2(cut: int) -> Column:
        return start - cut >= p2

    is_ = lambda *forms: ending.isin(*forms)
    after_ic = F.when(base.endswith("ic"), F.when(in_r2(2), _without(base, 2)).otherwise(F.concat(_without(base, 2), F.lit("iqU")))).otherwise(base)
    without_at = _without(base, 2)
    after_at = (
        F.when(~(base.endswith("at") & in_r2(2)), base)
        .when(without_at.endswith("ic"), F.when(in_r2(4), _without(base, 4)).otherwise(F.concat(_without(base, 4), F.lit("iqU"))))
        .otherwise(without_at)
    )
    after_iv = (
        F.when(~in_r2(2), base)
        .when(without_at.endswith("at") & in_r2(4), _without(base, 4))
        .otherwise(_without(base, 2))
    )
    after_ement = (
        F.when(base.endswith("iv"), after_iv)
        .when(base.endswith("eus"), F.when(in_r2(3), _without(base, 3)).when(start - 3 >= p1, F.concat(_without(base, 3), F.lit("eux"))).otherwise(base))
        .when(base.endswith("abl") | base.endswith("iqU"), F.when(in_r2(3), _without(base, 3)).otherwise(base))
        .otherwise(base)
    )
    last = F.substring(base, -1, 1)
    applied = (
        F.when(is_("ance", "ances", "iqUe", "iqUes", "isme", "ismes", "able", "ables", "iste", "istes", "eux") & two, base)
        .when(ending.rlike("^(?:atrices?|ateurs?|ations?)$") & two, after_ic)
        .when(is_("logie", "logies") & two, F.concat(base, F.lit("log")))
        .when(is_("usion", "usions", "ution", "utions") & two, F.concat(base, F.lit("u")))
        .when(is_("ence", "ences") & two, F.concat(base, F.lit("ent")))
        .when(is_("ement", "ements") & verb, after_ement)
        .when(is_("if", "ifs", "ive", "ives") & two, after_at)
        .when(is_("eaux"), F.concat(base, F.lit("eau")))
        .when(is_("aux") & one, F.concat(base, F.lit("al")))
        .when(is_("euse", "euses") & two, base)
        .when(is_("euse", "euses") & one, F.concat(base, F.lit("eux")))
        .when(is_("issement", "issements") & one & last.rlike(_C), base)
    )
    rewritten = (
        F.when(is_("amment") & verb, F.concat(base, F.lit("ant")))
        .when(is_("emment") & verb, F.concat(base, F.lit("ent")))
        .when(is_("ment", "ments") & (start - 1 >= pv) & last.rlike(_V), base)
    )
    return applied, rewritten


def with_stems(words: DataFrame, word: str = "word", stem: str = "stem") -> DataFrame:
    """Adds the stem of each word. Words starting with a digit are their own stem."""
    w = F.col("_w")
    step = words.withColumn("_w", _marked(F.col(word)))
    step = step.withColumns(
        {
            "_pv": _region_start(w, f"^(?:{_V}{_V}.|par|col|tap|.{_C}*{_V})"),
            "_p1": _region_start(w, f"^{_C}*{_V}+{_C}"),
            "_p2": _region_start(w, f"^{_C}*{_V}+{_C}{_C}*{_V}+{_C}"),
            "_s1": _ending(w, STEP_1_ENDINGS),
        }
    )
    applied, rewritten = _standard_suffix(w, F.col("_s1"))
    step = step.withColumns({"_r1": F.when(F.col("_s1") != "", applied), "_f1": rewritten})
    step = step.withColumn("_w", F.coalesce("_r1", "_f1", "_w"))

    # Verb endings, looked for inside RV only.
    rv = F.col("_rv")
    step = step.withColumn("_rv", F.expr("substring(_w, _pv + 1)"))
    step = step.withColumn("_s2", _ending(rv, I_VERB_ENDINGS))
    before = F.substring(_without(rv, F.col("_s2")), -1, 1)
    step = step.withColumn(
        "_r2",
        F.when(F.col("_r1").isNull() & (F.col("_s2") != "") & before.rlike(_C), _without(w, F.col("_s2"))),
    )
    step = step.withColumn("_s3", _ending(rv, ["ions", *PLAIN_VERB_ENDINGS, *A_VERB_ENDINGS]))
    cut = _without(w, F.col("_s3"))
    cut_rv = _without(rv, F.col("_s3"))
    step = step.withColumn(
        "_r3",
        F.when(
            F.col("_r1").isNull() & F.col("_r2").isNull(),
            F.when(F.col("_s3") == "ions", F.when(F.length(cut) >= F.col("_p2"), cut))
            .when(F.col("_s3").isin(*PLAIN_VERB_ENDINGS), cut)
            .when(F.col("_s3") != "", F.when(cut_rv.endswith("e"), _without(cut, 1)).otherwise(cut)),
        ),
    )
    step = step.withColumn("_altered", F.coalesce("_r1", "_r2", "_r3"))

    # Residual endings when nothing was removed so far.
    step = step.withColumn(
        "_w",
        F.when(F.col("_altered").isNotNull(), F.regexp_replace("_altered", "Y$", "i")).otherwise(
            F.regexp_replace("_w", "(?<=[^aious])s$", "")
        ),
    )
    step = step.withColumn("_rv", F.expr("substring(_w, _pv + 1)"))
    step = step.withColumn("_s4", F.when(F.col("_altered").isNull(), _ending(rv, ["ion", "ier", "Ier", "e"])).otherwise(""))
    rest = _without(w, F.col("_s4"))
    step = step.withColumn(
        "_w",
        F.when(
            F.col("_s4") == "ion",
            F.when((F.length(rest) >= F.col("_p2")) & rv.rlike("[st]ion$"), rest).otherwise(w),
        )
        .when(F.col("_s4").isin("ier", "Ier"), F.concat(rest, F.lit("i")))
        .when(F.col("_s4") == "e", rest)
        .otherwise(w),
    )
    undoubled = F.regexp_replace(w, "(?<=en)n$|(?<=on)n$|(?<=et)t$|(?<=el)l$|(?<=eil)l$", "")
    result = F.when(F.col(word).rlike("^[0-9]"), F.col(word)).otherwise(F.translate(undoubled, "IUY", "iuy"))
    # The result comes out of a generator so that a filter on the stem is not
    # rewritten in terms of the whole chain of expressions above.
    return step.select("*", F.explode(F.array(result)).alias(stem)).drop(
        "_w", "_pv", "_p1", "_p2", "_s1", "_r1", "_f1", "_rv", "_s2", "_r2", "_s3", "_r3", "_altered", "_s4"
    )
