"""Secret scans: a random forest removes false positives from candidate strings. DataFrame and SQL functions only.

Candidates are values assigned to a name that speaks of secrets (in quotes, all up to the closing quote of the line; without, up to a
blank, quote, comma or semicolon), passwords in addresses, private-key blocks, runs of at least 8 key characters with a letter and a
digit, and runs of at least 20 letters. Names, values, addresses and key blocks may be of any length. One regular expression, which reads a text once, marks
them; the text is split at the marks into an array of what lies between and of candidates, and everything else happens on that array, so no
shuffle is needed to find them. Each is described by its length, character transitions, dictionary coverage, path signs and neighbouring
words; the forest is trained from labelled findings (by default a built-in set, made from templates by a seed) and scores every
candidate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlab.session import materialise

MARK = "<SECRET>"
THRESHOLD = 0.5
#: Code points of context before and after a candidate.
AROUND = 64
#: Stands at both ends of a candidate while a text is taken apart: a noncharacter, no sign of any text. One found in a text counts as U+FFFD.
EDGE, OTHER = "\ufdd0", "\ufffd"

# The candidates. What starts with a key character is looked for at the start of a run only, and possessively, so no sign is read more than
# a few times; names are searched for words of secrets only where a sign of assignment follows. A key block runs to the next five dashes,
# which must begin its end line.
_KEY = r"A-Za-z0-9+/_\-"
_ASSIGN = r"[\"'\])]{0,2}+[ \t]*+(?:=>|:=|[:=])"
_NAME = r"(?>[A-Za-z0-9_\-]*?(?i:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|api[_-]?key|access[_-]?key|private[_-]?key|auth[_-]?key))[A-Za-z0-9_\-]*+"
_QUOTED = "|".join(rf"(?<={q})(?!{q})[^{q}\\\r\n]*+(?:\\.[^{q}\\\r\n]*+)*+(?={q})" for q in "\"'`")
_BARE = r"[^\s\"'`<>,;]*[^\s\"'`<>,;.!?):]"
ASSIGNED = rf"(?=[A-Za-z0-9_\-]{{3,}}+{_ASSIGN})({_NAME}{_ASSIGN}[ \t]*+[\"'`]?+)(?!-----BEGIN )({_QUOTED}|{_BARE})"
RUN = rf"((?=[A-Za-z+/_\-]*+[0-9])(?=[0-9+/_\-]*+[A-Za-z])[{_KEY}]{{8,}}+={{0,2}}+)"
LETTERS = rf"([A-Za-z]{{20,}}+(?![{_KEY}]))"
ADDRESS = r"(://[^\s/:@\"'<>]++:)([^\s/@:\"'<>]++)(?=@)"
_KIND = r"[A-Z0-9 ]*?PRIVATE KEY(?: BLOCK)?-----"
BLOCK = rf"(-----BEGIN {_KIND}[^\-]++(?:-(?!----)[^\-]*+)*+-----END {_KIND})"
CANDIDATE = rf"(?<![A-Za-z0-9_\-])(?:{ASSIGNED}|(?<![+/])(?:{RUN}|{LETTERS}))|{ADDRESS}|{BLOCK}"
_MARKED = f"$1$5{EDGE}$2$3$4$6$7{EDGE}"

#: Word lists of the features.
KEY_WORDS = "token|secret|passwd|password|pwd|apikey|api_key|api-key|access_key|auth|bearer|credential|private|signing|client_key"
SUM_WORDS = "sha1|sha256|sha512|sha|md5|commit|checksum|hash|digest|revision|rev|uuid|guid|etag|blob|tree|integrity|version|build"
FILLER = "example|sample|dummy|your|changeme|placeholder|xxxx|0000|1234567|abcdef|test|fake|redacted"
DICTIONARY = "the|and|for|with|from|this|that|key|api|file|image|page|part|user|name|date|time|data|test|long|title|article|lib|usr|python|site|packages|content|upload|version|release|index|html|node|module|server|client|config|default|source|build|report|final|draft|summer|winter|photo|video|your|here|insert|token|secret|value|string|number|example|sample|about|guide|how|what|news|blog|post"
FEATURES = ["size", "digit_share", "upper_share", "symbol_share", "distinct_share", "class_changes", "vowel_changes", "hex_only", "letters_only", "covered", "slashes", "extension", "url", "dashes", "key_word", "sum_word", "assigned", "quoted", "filler", "prefix", "longest_letters", "credentials", "key_block", "called", "blanks", "password"]


def _pieces(text: Column) -> Column:
    """The text as an array: what lies before a candidate, the candidate, and so on, what lies after the last."""
    return F.split(F.regexp_replace(F.translate(text, EDGE, OTHER), F.lit(CANDIDATE), F.lit(_MARKED)), EDGE)


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, not once per element of the arrays that body walks over."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _starts(pieces: Column, step: int = 128) -> Column:
    """Code points before each piece: sums of whole steps of pieces first, then within a step."""
    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)
    steps = lambda sizes: F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / step)), lambda k: total(F.slice(sizes, (k * step + 1).cast("int"), F.lit(step))))
    sums = lambda each: F.aggregate(each, F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    within = lambda sizes, i: total(F.slice(sizes, (F.floor(i / step) * step + 1).cast("int"), i % step))
    placed = lambda sizes, before: F.transform(sizes, lambda _, i: F.get(before, F.floor(i / step).cast("int")) + within(sizes, i))
    return _bound(F.transform(pieces, F.char_length), lambda sizes: _bound(sums(steps(sizes)), lambda before: placed(sizes, before)))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, version, nth, start, candidate, before, after, word): every candidate of every text, in order, with what surrounds it.

    start counts code points from 0; version is a hash of the text. Null and empty texts have no candidates; repeated rows have theirs
    each. Texts of any length and with any number of candidates are read whole, in time linear in their length.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(F.col("text").rlike(CANDIDATE))
    tail = lambda s: F.right(s, F.lit(AROUND))

    def found(pieces: Column, starts: Column) -> Column:
        at = lambda i: F.coalesce(F.get(pieces, i), F.lit(""))
        return F.transform(F.sequence(F.lit(1), F.size(pieces) - 2, F.lit(2)), lambda i: F.struct(
            F.floor(i / 2).cast("int").alias("nth"), F.get(starts, i).alias("start"), at(i).alias("candidate"),
            tail(F.concat(tail(at(i - 2)), tail(at(i - 1)))).alias("before"), F.left(F.concat(F.left(at(i + 1), F.lit(AROUND)), F.left(at(i + 2), F.lit(AROUND))), F.lit(AROUND)).alias("after"),
        ))

    every = _bound(_pieces(F.col("text")), lambda pieces: _bound(_starts(pieces), lambda starts: found(pieces, starts)))
    got = rows.select("doc_id", F.xxhash64("text").alias("version"), F.inline(F.filter(every, lambda x: x["candidate"] != "")))
    word = F.concat(F.regexp_extract("before", r"(\S*)$", 1), F.left("candidate", F.lit(400)), F.regexp_extract("after", r"^(\S*)", 1))
    return got.withColumn("word", word)


def _share(s: Column, pattern: str) -> Column:
    return F.regexp_count(s, F.lit(pattern)) / F.char_length(s)


def described(found: DataFrame) -> DataFrame:
    """found (candidate, before, after, word) plus the columns FEATURES, all doubles."""
    s, low = F.col("candidate"), F.lower("candidate")
    left, around = F.lower("before"), F.lower(F.concat_ws(" ", "before", "after"))
    flag = lambda c: c.cast("double")
    made = {
        "size": F.char_length(s),
        "digit_share": _share(s, "[0-9]"),
        "upper_share": _share(s, "[A-Z]"),
        "symbol_share": _share(s, "[^A-Za-z0-9]"),
        "distinct_share": F.size(F.array_distinct(F.split(s, ""))) / F.char_length(s),
        "class_changes": _share(s, "[a-z](?=[A-Z0-9])|[A-Z](?=[a-z0-9])|[0-9](?=[A-Za-z])"),
        "vowel_changes": _share(low, "[aeiou](?=[b-df-hj-np-tv-z])|[b-df-hj-np-tv-z](?=[aeiou])"),
        "hex_only": flag(low.rlike("^[0-9a-f-]++$")),
        "letters_only": flag(low.rlike("^[a-z]++$")),
        "covered": 1 - F.char_length(F.regexp_replace(low, f"({DICTIONARY})", "")) / F.char_length(s),
        "slashes": F.regexp_count("word", F.lit(r"[/\\]")),
        "extension": flag(F.lower("word").rlike(r"\.(py|js|html?|png|jpe?g|gif|txt|pdf|css|json|xml|zip|gz|so|jar|md)\b")),
        "url": flag(F.lower("word").rlike(r"://|www\.|data:")),
        "dashes": F.regexp_count(s, F.lit("[-_]")),
        "key_word": flag(left.rlike(f"({KEY_WORDS})")),
        "sum_word": flag(around.rlike(rf"\b({SUM_WORDS})\b")),
        "assigned": flag(F.col("before").rlike(r"[=:][^A-Za-z0-9]*$")),
        "quoted": flag(F.col("before").rlike("[\"'`]$")),
        "filler": flag(low.rlike(f"({FILLER})") | around.rlike(r"\b(example|sample|dummy|placeholder)\b")),
        "prefix": flag(s.rlike("^(AKIA|ghp_|gho_|sk-|sk_live_|xox[bp]-|glpat-|AIza|SG|eyJ)")),
        "longest_letters": F.array_max(F.transform(F.split(low, "[^a-z]+"), F.char_length)),
        "credentials": flag(F.col("before").rlike(r"://[^\s/:@]+:$") & F.col("after").startswith("@")),
        "key_block": flag(s.startswith("-----BEGIN")),
        "blanks": _share(s, r"\s"),
        "password": flag(left.rlike(r"(pass(word|wd|phrase|code)?|pwd)[\"'\])]{0,2}+\s*+[=:]")),
        "called": flag(s.contains("(") | s.contains("{") | s.contains("$")),
    }
    return found.withColumns({k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in made.items()})


#: Labelled findings as (label, before, candidate, after). {name} stands for a word of LISTS, {h..} for hexadecimal digits, {b..}
#: for letters of both cases and digits, {a..} for letters of both cases, {p..} for digits and letters with signs, all made from the seed.
TEMPLATES = [
    (1, '{text} {key}{eq}{q}', "{h40}", "{q} {text}"),
    (1, "{text} {key}{eq}{q}", "{H40}", "{q} {text}"),
    (1, "{text} {key}{eq}{q}", "{h32}", "{q}, {text}"),
    (1, "{text} {key}{noise}{eq}{noise}{q}", "{h40}", "{q}{noise} {text}"),
    (1, "{text} {key}{noise}{eq}{noise}{q}", "{H40}", "{q}{noise} {text}"),
    (1, "{text} {key}{eq}{q}", "{b32}", "{q} {text}"),
    (1, "{text} {key}{noise}{eq}{q}", "{b24}", "{q}{noise} {text}"),
    (1, "{text} ", "{vendor}{b36}", " {text}"),
    (1, "use {key}: ", "{vendor}{b24}", ". {text}"),
    (1, "{text} aws ", "AKIA{B16}", " {text}"),
    (1, "{text} {key}{eq}{q}", "{a24}", "{q} {text}"),
    (1, "{text} {pass}{eq}{q}", "{p10}", "{q} {text}"),
    (1, "{text} {pass}{eq}", "{p12}", "\n{text}"),
    (1, "{text} {pass}{eq}{q}", "{word}{p5}", "{q} {text}"),
    (1, "{text} {pass}{eq}{quote}", "{p5}", "{quote} {text}"),
    (1, "{text} {pass}{eq}{quote}", "{word} {word2} {word3} {word4}", "{quote} {text}"),
    (1, "{text} {pass}{eq}{quote}", "{p5};{p10}", "{quote}; {text}"),
    (1, "{text} {key}{eq}{quote}", "{b12};{b24}", "{quote}, {text}"),
    (1, "{text}\n", "-----BEGIN PGP PRIVATE KEY BLOCK-----\nVersion: 1.{d2}\n\n{b36}{b24}\n{b32}\n-----END PGP PRIVATE KEY BLOCK-----", "\n{text}"),
    (1, "{text} {scheme}://{word}:", "{b36}{b40}{b36}", "@db.{word}.net/{word}"),
    (1, "{text}\n", "-----BEGIN PRIVATE KEY-----\n" + "{b36}{b24}\n{h40}{b12}\n" * 20 + "-----END PRIVATE KEY-----", "\n{text}"),
    (1, "{text} {key}{eq}{quote}", "-----BEGIN EC PRIVATE KEY-----\n" + "{h40}{h24}\n" * 9 + "-----END EC PRIVATE KEY-----", "{quote} {text}"),
    (1, "{text} {scheme}://{word}:", "{h40}", "@{word}.{word2}/{word}"),
    (1, "{text} {scheme}://{word}:", "{h40}{h32}{h40}", "@{word}/{word2}"),
    (1, "{text} {scheme}://{word}:", "{p10}", "@{word}.com/{word}"),
    (1, "{text} {scheme}://{word}:", "{b12}", "@db.{word}.net:5432/{word}"),
    (1, "{text}\n", "-----BEGIN RSA PRIVATE KEY-----\n{b36}{b24}\n{b32}\n-----END RSA PRIVATE KEY-----", "\n{text}"),
    (1, "{text} authorization: bearer ", "eyJ{b32}{b24}", ".{text}"),
    (0, "{text} {sum} ", "{h40}", " {text}"),
    (0, "{text} {sum}{eq}", "{h40}", " {text}"),
    (0, "{text} {sum}:", "{h40}{h24}", " {text}"),
    (0, "{text} {sum} ", "{H32}", ", {text}"),
    (0, "{text} ", "{h7}{h1}", " {text}"),
    (0, "{text} {id} ", "{h8}-{h4}-4{h3}-a{h3}-{h12}", " {text}"),
    (0, "{text} /", "usr/lib/python3/site-packages/{word}{d2}", ".py {text}"),
    (0, "{text} {scheme}://www.{word}.com/", "{word}/{word}-{word}-{d4}", ".html {text}"),
    (0, "{text} ", "{word}-{word}-{word}-{d4}", " {text}"),
    (0, "{text} ", "{word}{word}{d2}", " {text}"),
    (0, "{text} ", "get{Word}{Word}{d2}", " {text}"),
    (0, "{text} ", "{word}{Word}V2", "({text}"),
    (0, "{key} {text} ", "{Word}{Word}{d2}{Word}", " {text}"),
    (0, "{text} ", "{word}_{word}_{d4}", ".png {text}"),
    (0, "{text} ", "20{d2}-01-{d2}T10", ":30:00Z {text}"),
    (0, "{text} ", "{word}{word}{word}{word}", " {text}"),
    (0, "{text} {key}{eq}{q}", "your_{word}_key_here_{d2}", "{q} {text}"),
    (0, "{text} {key}{eq}{q}", "xxxxxxxxxxxx{d4}", "{q} {text}"),
    (0, "{text} {key}{eq}{q}", "example_token_1234567", "{q} {text}"),
    (0, "{text} {pass}{eq}{q}", "changeme_{word}", "{q} {text}"),
    (0, "{text} {pass}: ", "{word}{word}", " {text}"),
    (0, "{text} {key}: ", "{word}", " {text}"),
    (0, "{text} {pass}{eq}", "{short}", " {text}"),
    (0, "{text} {key}{eq}", "{short}", " {text}"),
    (0, "{text} {key}{eq}{quote}", "{short}", "{quote} {text}"),
    (0, "{text} {pass}{eq}{quote}", "{say} {word} {text}", "{quote} {text}"),
    (0, "{text} {pass}{eq}{quote}", "{say} {text} {word} {say}", "{quote} {text}"),
    (0, "{text} {key}{eq}{quote}", "{say} {word} {text} {word2} {text}", "{quote} {text}"),
    (0, "{text} {key}{eq}{quote}", "{text} {word} {word2} {text}", "{quote} {text}"),
    (0, "{text} {pass}{eq}{quote}", "{Word} {text} {d2} {word2}, {text} {word3}.", "{quote} {text}"),
    (0, "{text} {pass} = ", "get_{word}({word}", ") {text}"),
    (0, "{text} {key} = ", "self.{word}.{word}", " {text}"),
    (0, "{text} {key}{eq}", "${{word}_{word}}", " {text}"),
    (0, "{text} data:image/png;base64,", "iVBORw0KGgo{b36}{b36}==", " {text}"),
    (0, "{text} {scheme}://localhost:", "{d4}", "@{text}"),
]
LISTS = {
    "text": ["the report of", "as seen in", "und der", "de la", "see", "about the", "los", "it was", "def run", "import"],
    "key": ["token", "secret", "api_key", "password", "auth_token", "TOKEN", "SECRET_KEY", "private key", "access_key", "client_secret"],
    "pass": ["password", "passwd", "pwd", "DB_PASSWORD", "passphrase", "Password"],
    "eq": [" = ", ": ", "=", " := ", "="],
    "q": ['"', "'", "", '"'],
    "quote": ['"', "'", '"', "`"],
    "short": ["a", "no", "yes", "is", "the", "null", "none", "true", "1", "0", "42", "not", "that", "and", "el", "der", "un", "who", "str", "int", "%s", "{}", "[", "(", "*", "...", "-", "***", "your", "here"],
    "say": ["enter your", "please type the", "your new", "must have 8", "is required for", "forgot your", "the", "choose a strong", "do not share this", "change the", "invalid", "at least 10 signs of"],
    "noise": ["", "!!", "..", "||", ",", "??", "##", "&&&"],
    "vendor": ["ghp_", "sk_live_", "glpat-", "xoxb-", "AIza", "sk-"],
    "sum": ["commit", "sha1", "revision", "checksum:", "etag:", "md5", "blob", "hash", "sha256", "digest", "integrity"],
    "id": ["uuid", "id", "", "guid:", "request"],
    "scheme": ["https", "postgres", "http", "amqp", "mysql", "ftp"],
    "word": ["winter", "report", "index", "config", "client", "module", "harbour", "required", "string", "value", "article", "guide", "photo", "garden", "number", "server", "hidden", "field", "news", "final", "lantern", "orbit"],
}


def labelled_findings(spark: SparkSession, n: int = 10_000, seed: int = 5) -> DataFrame:
    """(candidate, before, after, word, label): n labelled findings, TEMPLATES in turn filled in from a seed."""
    i = F.col("id")
    rows = spark.range(0, n, 1, 4)
    part = lambda k: F.sha2(F.concat_ws("-", F.lit(f"{seed}-{k}"), i.cast("string")), 512)
    rows = rows.select("id", part("h").alias("h"), part("b").alias("b"))
    both = F.translate(F.base64(F.unhex(F.concat("b", "h"))), "+/=\n", "xY")
    rows = rows.select("id", "h", both.alias("b"))
    letters = F.translate("b", "0123456789", "qRstUVwXyZ")
    signed = F.translate("b", "abcdefg", "!@$%^&*")
    rows = rows.select("id", "h", "b", letters.alias("a"), signed.alias("p"), F.array(*[F.struct(F.lit(t[0]).alias("label"), F.lit(t[1]).alias("before"), F.lit(t[2]).alias("candidate"), F.lit(t[3]).alias("after")) for t in TEMPLATES]).alias("all"))
    rows = rows.select("id", "h", "b", "a", "p", F.inline(F.array(F.element_at("all", (F.pmod("id", F.lit(len(TEMPLATES))) + 1).cast("int")))))
    for name, words in LISTS.items():
        rows = rows.withColumn(f"_{name}", F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(F.xxhash64("id", F.lit(f"{name}{seed}")), F.lit(len(words))) + 1).cast("int")))
    for k in (2, 3, 4):
        rows = rows.withColumn(f"_word{k}", F.element_at(F.array(*[F.lit(w) for w in LISTS["word"]]), (F.pmod(F.xxhash64("id", F.lit(f"word{k}-{seed}")), F.lit(len(LISTS["word"]))) + 1).cast("int")))
    digits = F.lpad(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(10_000)).cast("string"), 4, "0")

    def filled(c: str) -> Column:
        out = F.col(c)
        for k in (1, 3, 4, 7, 8, 12, 24, 32, 40):
            out = F.replace(out, F.lit(f"{{h{k}}}"), F.substring("h", 1 + k, k))
        for k in (32, 40):
            out = F.replace(out, F.lit(f"{{H{k}}}"), F.upper(F.substring("h", 1 + k, k)))
        for k in (12, 24, 32, 36, 40):
            out = F.replace(out, F.lit(f"{{b{k}}}"), F.substring("b", 1 + k, k))
        out = F.replace(out, F.lit("{B16}"), F.upper(F.substring("b", 90, 16)))
        out = F.replace(F.replace(F.replace(out, F.lit("{p10}"), F.substring("p", 20, 10)), F.lit("{p12}"), F.substring("p", 60, 12)), F.lit("{p5}"), F.substring("p", 80, 5))
        out = F.replace(F.replace(F.replace(out, F.lit("{a24}"), F.substring("a", 30, 24)), F.lit("{d4}"), digits), F.lit("{d2}"), F.substring(digits, 1, 2))
        for name in [*LISTS, "word2", "word3", "word4"]:
            out = F.replace(out, F.lit(f"{{{name}}}"), F.col(f"_{name}"))
        out = F.replace(out, F.lit("{Word}"), F.initcap("_word"))
        return out.alias(c)

    made = rows.select("label", filled("before"), filled("candidate"), filled("after"))
    tight = F.concat(F.regexp_extract("before", r"(\S*)$", 1), "candidate", F.regexp_extract("after", r"^(\S*)", 1))
    return made.select("candidate", F.right("before", F.lit(AROUND)).alias("before"), F.left("after", F.lit(AROUND)).alias("after"), tight.alias("word"), "label")


def train(labelled: DataFrame, trees: int = 30, depth: int = 8, seed: int = 5) -> RandomForestClassificationModel:
    """A random forest on labelled findings (candidate, before, after, word, label)."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(described(labelled)).select("features", F.col("label").cast("double").alias("label"))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(rows)


_DEFAULT: dict[str, RandomForestClassificationModel] = {}


def default_model(spark: SparkSession) -> RandomForestClassificationModel:
    """The forest of the built-in findings, trained once per application."""
    app = spark.sparkContext.applicationId
    if app not in _DEFAULT:
        _DEFAULT[app] = train(labelled_findings(spark))
    return _DEFAULT[app]


def _scored(docs: DataFrame, model: RandomForestClassificationModel | None, id_col: str, text_col: str, threshold: float) -> DataFrame:
    model = model or default_model(docs.sparkSession)
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(described(candidates(docs, id_col, text_col)))
    scored = model.transform(ready).withColumn("score", F.round(vector_to_array("probability")[1], 6))
    return scored.withColumn("is_secret", F.col("score") >= threshold)


def scan(docs: DataFrame, model: RandomForestClassificationModel | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, start, length, candidate, score, is_secret): every candidate, scored, each occurrence with its own place.

    An empty table gives an empty result; null ids are kept; other columns are ignored. Repeated rows have their findings each.
    """
    return _scored(docs, model, id_col, text_col, threshold).select("doc_id", "start", F.char_length("candidate").cast("long").alias("length"), "candidate", "score", "is_secret")


def redact(docs: DataFrame, model: RandomForestClassificationModel | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with every secret of a text replaced by MARK where it stands; columns as in docs, every row kept.

    A candidate that is a secret in one place of a text is replaced in all of them. Only texts with a candidate meet their findings, by id
    and hash of the text; others pass. Null and empty texts pass.
    """
    some = F.coalesce(F.col(text_col).rlike(CANDIDATE), F.lit(False))
    likely = materialise(docs.filter(some).withColumn("__weftlab_version", F.xxhash64(text_col)), "likely")
    doc = [F.col("doc_id").alias("__weftlab_id"), F.col("version").alias("__weftlab_of")]
    same = _scored(likely, model, id_col, text_col, threshold).groupBy(*doc, "candidate").agg(F.max("is_secret").alias("is_secret"), F.collect_set("nth").alias("nths"))
    each = same.select("__weftlab_id", "__weftlab_of", "is_secret", F.explode("nths").alias("nth"))
    found = each.groupBy("__weftlab_id", "__weftlab_of").agg(F.sort_array(F.collect_list(F.struct("nth", "is_secret"))).alias("__weftlab_found"))
    found = found.filter(F.exists("__weftlab_found", lambda x: x["is_secret"]))
    joined = likely.join(found, F.col(id_col).eqNullSafe(F.col("__weftlab_id")) & (F.col("__weftlab_version") == F.col("__weftlab_of")), "left")
    secret = lambda i: (i % 2 == 1) & F.get(F.col("__weftlab_found"), F.floor(i / 2).cast("int"))["is_secret"]
    clean = F.array_join(F.transform(_pieces(F.col(text_col)), lambda p, i: F.when(secret(i), MARK).otherwise(p)), "")
    done = joined.withColumn(text_col, F.when(F.col("__weftlab_found").isNull(), F.col(text_col)).otherwise(clean)).select(*docs.columns)
    return docs.filter(~some).unionByName(done)
