"""Operator 1: secret scans with a random forest that removes false positives, in DataFrame functions only.

A scan finds candidates: long runs of key characters that hold a digit, and whatever follows a secret's name and an
assignment, short, wordy or with other characters as it may be, and the password of a URL. Each gets features of its length, its character
transitions, how much of it is words of the corpus, its file's path and the words next to it. A random forest trained
on labelled findings gives the probability that a candidate is a secret.

Findings are a table of the caller's; `example_findings` makes one by rules, of public shapes of keys, hashes, numbers
and names in several surroundings, crossed so that neither shape nor surroundings alone decide. A corpus can add its own candidates
labelled by an expression; as that reads the neighbours, the features that repeat it are masked in those rows, so the
forest does not just learn the rule back.

Corpus words are counted over all documents, but only those that are a piece of a candidate: words meet the short
list of pieces in a join before they are counted. The forest sees at most `max_labelled` findings (documented bound,
those of least hash).
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .jobs import saved

CANDIDATE = r"[A-Za-z0-9_+/-]{16,}={0,2}"
NEAR = 48  #: characters on each side that count as neighbours
MAX_LABELLED = 20_000
BROADCAST_BYTES = 16 << 20
#: Neighbouring words that name a secret, or something that looks like one; what stands for a value; frequent letter pairs; paths.
SECRET_WORDS = r"(?i)(?:token|secret|passw|pwd|api.?key|access.?key|private.?key|auth|bearer|credential)"
OTHER_WORDS = r"(?i)example|sample|dummy|placeholder|checksum|sha-?\d*|md5|commit|hash|uuid|digest|card|phone|isbn"
STAND_INS = r"(?i)^(?:x+|\*+|\.+|your.*|change.?me.*|example.*|none|null|true|false|todo|test|dummy.*|placeholder.*|[$<{%].*)$"
FREQUENT_PAIRS = r"th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le"
TEST_PATH = r"(?i)(^|[/_.-])(tests?|examples?|samples?|fixtures?|docs?|mock)([/_.-]|$)"
CONFIG_PATH = r"(?i)\.(env|ya?ml|json|toml|ini|cfg|conf|properties|tf)$"
#: A secret's name and what assigns a value to it, right before the value.
NAMED = SECRET_WORDS + r"[A-Za-z0-9_.-]{0,16}[\"']?\s{0,3}(?:[:=]|\bis\b)\s{0,3}(?:(?:bearer|basic)\s)?[\"']?"
NAMED_VALUE = r"(?!(?i:bearer|basic)\b)[^\s\"'<>,;]{6,}"
#: The password of a URL with a user, and a URL that has one.
URL_PASSWORD = r"(?<=:)(?<=://[^\s:/@]{0,64}:)[^\s@/:]{6,128}(?=@)"
URL_WITH_PASSWORD = r"://[^\s:/@]{0,64}:[^\s@/:]{6,128}@"
#: Features of the value, of its path, and of its neighbours; DEFINING are those that a label by neighbours repeats.
DEFINING = ["f_secret_word", "f_other_word", "f_assigned", "f_quoted"]
FEATURES = ["f_length", "f_digits", "f_uppers", "f_symbols", "f_turns", "f_case_turns", "f_pairs", "f_vowels", "f_distinct", "f_hex", "f_covered", "f_test_path", "f_config_path", "f_depth", "f_near_letters", "f_near_symbols", "f_in_url", *DEFINING]
MASKED = 0.5


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: Column | None = None) -> DataFrame:
    """(id, finding, secret, before, after, path): the candidates of each text in order, with what stands around them."""
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    named = F.col("t").rlike(NAMED + NAMED_VALUE) | F.col("t").rlike(URL_WITH_PASSWORD)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce((path if path is not None else F.lit("")).cast("string"), F.lit("")).alias("path"), t.alias("t"))
    rows = rows.where(F.col("t").rlike(CANDIDATE) | named)
    both = f"(?<={NAMED}){NAMED_VALUE}|{URL_PASSWORD}|{CANDIDATE}"
    # looking back at every character is dear, so only texts with a named value are cut that way
    rows = rows.withColumn("named", named)
    found = F.when(F.col("named"), F.regexp_extract_all("t", F.lit(both), F.lit(0))).otherwise(F.regexp_extract_all("t", F.lit(CANDIDATE), F.lit(0)))
    gaps = F.when(F.col("named"), F.split("t", both, -1)).otherwise(F.split("t", CANDIDATE, -1))
    rows = rows.select("id", "path", found.alias("found"), gaps.alias("gaps"))
    near = F.transform("gaps", lambda g: F.struct(F.right(g, F.lit(NEAR)).alias("last"), F.left(g, F.lit(NEAR)).alias("first")))
    rows = rows.select("id", "path", "found", near.alias("gaps"))
    every = F.transform("found", lambda s, k: F.struct(k.alias("k"), s.alias("secret"), F.get("gaps", k)["last"].alias("before"), F.get("gaps", k + 1)["first"].alias("after")))
    kept = F.filter(every, lambda s: s["secret"].rlike(f"^{CANDIDATE}$") & s["secret"].rlike("[0-9]") | s["before"].rlike(NAMED + "$") | s["before"].rlike(":$") & s["after"].rlike("^@"))
    return rows.select("id", "path", F.posexplode(kept).alias("finding", "s")).select("id", "finding", "s.secret", "s.before", "s.after", "path")


def _pieces(secret: Column) -> Column:
    return F.regexp_extract_all(F.lower(secret), F.lit("[a-z]{3,}"), F.lit(0))


def corpus_words(docs: DataFrame, found: DataFrame, text_col: str = "text", least: int = 3) -> DataFrame:
    """(word): pieces of candidates that are words of at least `least` documents on their own."""
    pieces = saved(found.select(F.explode(_pieces(F.col("secret"))).alias("word")).distinct())
    size = pieces.agg(F.sum(F.length("word") + 32)).first()[0] or 0
    side = F.broadcast(pieces) if size <= BROADCAST_BYTES else pieces
    longest = pieces.agg(F.max(F.length("word"))).first()[0] or 3
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text_col).cast("string")), F.lit(f"(?<![a-z0-9_+/=-])[a-z]{{3,{longest}}}(?![a-z0-9_+/=-])"), F.lit(0)))
    return docs.select(F.explode(words).alias("word")).join(side, "word", "left_semi").groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("word")


def featured(found: DataFrame, words: DataFrame, *keep: str) -> DataFrame:
    """found(secret, before, after, path) with the columns of FEATURES and those named to keep; equal candidates look up
    their pieces once."""
    s = F.col("secret")
    found = found.select(*{"secret": 0, "before": 0, "after": 0, "path": 0, **dict.fromkeys(keep)})
    found = found.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("secret", "before", "after", "path")})
    distinct = found.select("secret").distinct()
    size = words.agg(F.sum(F.length("word") + 32)).first()[0] or 0
    known = F.broadcast(words) if size <= BROADCAST_BYTES else words
    cover = distinct.select("secret", F.explode(_pieces(s)).alias("word")).join(known, "word", "left_semi").groupBy("secret").agg(F.sum(F.length("word")).alias("letters"))
    n = F.greatest(F.length("secret"), F.lit(1)).cast("double")
    share = lambda pattern: F.regexp_count(s, F.lit(pattern)) / n
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    around = F.concat("before", "after")
    near = lambda pattern: F.regexp_count(around, F.lit(pattern)) / F.greatest(F.length(around), F.lit(1))
    return found.join(cover, "secret", "left").select(
        *found.columns,
        F.length("secret").cast("double").alias("f_length"),
        share("[0-9]").alias("f_digits"),
        share("[A-Z]").alias("f_uppers"),
        share("[^A-Za-z0-9]").alias("f_symbols"),
        share("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])").alias("f_turns"),
        share("[a-z](?=[A-Z])|[A-Z](?=[a-z])").alias("f_case_turns"),
        (F.regexp_count(F.lower(s), F.lit(FREQUENT_PAIRS)) / n).alias("f_pairs"),
        share("[aeiouAEIOU]").alias("f_vowels"),
        (F.size(F.array_distinct(F.split(s, ""))) / n).alias("f_distinct"),
        flag(s.rlike("^[0-9A-Fa-f]+$")).alias("f_hex"),
        (F.coalesce("letters", F.lit(0)) / n).alias("f_covered"),
        flag(F.col("path").rlike(TEST_PATH)).alias("f_test_path"),
        flag(F.col("path").rlike(CONFIG_PATH)).alias("f_config_path"),
        F.size(F.split("path", "/")).cast("double").alias("f_depth"),
        near("[A-Za-z]").alias("f_near_letters"),
        near("[^A-Za-z0-9 ]").alias("f_near_symbols"),
        flag(F.col("before").rlike(":/{0,2}$") & F.col("after").rlike("^@")).alias("f_in_url"),
        flag(F.col("before").rlike(SECRET_WORDS)).alias("f_secret_word"),
        flag(F.col("before").rlike(OTHER_WORDS)).alias("f_other_word"),
        flag(F.col("before").rlike("[:=]\\s*[\"']?$")).alias("f_assigned"),
        flag(F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']")).alias("f_quoted"),
    )


def train_forest(labelled: DataFrame, trees: int = 40, depth: int = 8, max_labelled: int = MAX_LABELLED) -> RandomForestClassificationModel | None:
    """A forest from rows with FEATURES and label 0/1 (null labels are left out); None unless both labels occur."""
    few = saved(labelled.where("label is not null").select(*FEATURES, F.col("label").cast("double").alias("label")).orderBy(F.xxhash64(*FEATURES, "label"), "label").limit(max_labelled))
    if few.select("label").distinct().count() < 2:
        return None
    rows = VectorAssembler(inputCols=FEATURES, outputCol="f_all", handleInvalid="keep").transform(few)
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, featureSubsetStrategy="sqrt", featuresCol="f_all").fit(rows.select("f_all", "label"))


def scan_secrets(docs: DataFrame, findings: DataFrame | None = None, label: Column | None = None, id_col: str = "doc_id", text_col: str = "text", path: Column | None = None, least: float = 0.5) -> DataFrame:
    """(id, finding, secret, probability, is_secret) for each candidate of each row of docs, in the order of the text.

    The forest learns from `findings`(secret, before, after, path, label), other columns ignored, and from the
    candidates themselves where `label`, an expression over (secret, before, after, path) and FEATURES, says 0 or 1;
    DEFINING features of the latter are masked. Without both labels the probability is null and every candidate stays a
    secret. Null and empty texts have no candidates; null ids stay; rows that repeat an id each have their findings.
    """
    found = saved(candidates(docs, id_col, text_col, path))
    words = saved(corpus_words(docs, found, text_col))
    rows = featured(found, words, "id", "finding")
    sources = []
    if findings is not None:
        sources.append(featured(findings, words, "label").select(*FEATURES, F.col("label").cast("double").alias("label")))
    if label is not None:
        own = rows.withColumn("label", label.cast("double")).withColumns({c: F.lit(MASKED) for c in DEFINING})
        sources.append(own.select(*FEATURES, "label"))
    forest = train_forest(reduce(DataFrame.unionByName, sources)) if sources else None
    if forest is None:
        out = rows.withColumn("probability", F.lit(None).cast("double"))
    else:
        scored = forest.transform(VectorAssembler(inputCols=FEATURES, outputCol="f_all", handleInvalid="keep").transform(rows))
        out = scored.withColumn("probability", F.round(vector_to_array("probability")[1], 9))
    return out.select(F.col("id").alias(id_col), "finding", "secret", "probability", F.coalesce(F.col("probability") >= least, F.lit(True)).alias("is_secret"))


def confirmed_by_assignment() -> Column:
    """A label for corpora without reviewed findings: 1 where a value is assigned to a name of a secret; 0 where it is a
    stand-in for one, or nothing is assigned, no secret is named nearby and the value is a number, words of the corpus
    or next to words of something else; null where it is open, such as a key in prose or in a header, or plain words."""
    before, secret = F.col("before"), F.col("secret")
    named = before.rlike(SECRET_WORDS + "[A-Za-z0-9_.-]{0,16}[\"']?\\s*[:=]\\s*[\"']?$")
    assigned = before.rlike("[:=]\\s*[\"']?$")
    wordy = F.col("f_covered") >= 0.7
    other = before.rlike(OTHER_WORDS) | secret.rlike("^[0-9]+$") | wordy
    return F.when(named & secret.rlike(STAND_INS), 0.0).when(named & wordy, F.lit(None)).when(named, 1.0).when(~assigned & ~before.rlike(SECRET_WORDS) & other, 0.0)


#: Surroundings of secrets and of what looks like them.
AROUND_SECRETS = [
    ('token = "', '"'), ("api_key: ", "\n"), ("export SECRET_KEY=", "\n"), ("Authorization: Bearer ", "\n"), ("the password is ", " and"), ('"access_token": "', '",'),
    ("secret='", "'"), ("use the credential ", " for"), ("https://", "@github.com/"), ("postgres://app:", "@db.internal/"), ("aws_access_key_id = ", "\n"), ("Cookie: auth=", "; path"),
]
AROUND_OTHERS = [
    ("commit ", " of"), ("md5: ", "\n"), ("id = ", ";"), ("paid by card ", " on"), ("see ", " for"), ('checksum = "', '"'), ("", "\n"), ("file ", ","), ("auth commit = ", "\n"),
    ("https://", "/index.html"), ("password uuid: ", "\n"),
]


def example_findings(spark: SparkSession, n: int = 4000, without: tuple[str, ...] = ()) -> DataFrame:
    """(secret, before, after, path, label): findings made by rules, half of each label; every shape of a kind stands in
    every surrounding of that kind. Shapes of hashes are in both kinds, where the neighbours decide, and stand-ins
    stand in the surroundings of secrets. without: families of keys to leave out, such as those of a test."""
    k = F.col("id")
    text = k.cast("string")
    sha, md5, mixed = F.sha1(text), F.md5(text), F.translate(F.base64(F.unhex(F.sha2(text, 256))), "+/=", "xYz")
    digits = F.lpad(F.pmod(F.xxhash64("id"), F.lit(10**16)).cast("string"), 16, "4")
    words = F.array(*map(F.lit, ["user", "order", "value", "index", "total", "result", "search", "account", "window", "number"]))
    word = lambda j: F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(j)), F.lit(10)) + 1).cast("int"))
    part = lambda a, b: F.substring(mixed, a, b)
    families = {
        "sha1": sha,
        "md5": md5,
        "plain": part(1, 40),
        "stripe": F.concat(F.lit("sk_live_"), part(1, 24)),
        "password": F.concat(part(1, 9), F.lit("!7.")),
        "aws": F.concat(F.lit("AKIA"), F.left(F.translate(F.upper(mixed), "0189", "QXYZ"), F.lit(16))),
        "dotted": F.concat_ws(".", part(1, 20), part(21, 20)),
        "github": F.concat(F.lit("ghp_"), part(1, 36)),
        "slack": F.concat_ws("-", F.lit("xoxb"), F.left(digits, F.lit(11)), F.right(digits, F.lit(12)), part(1, 24)),
        "jwt": F.concat(F.lit("eyJ"), part(1, 33)),
        "short": part(5, 12),
    }
    keys = [c for name, c in families.items() if name not in without]
    others = [sha, md5, F.concat_ws("-", F.left(md5, F.lit(8)), F.substring(md5, 9, 4), F.substring(md5, 13, 4), F.right(md5, F.lit(12))), digits, F.concat(F.lit("20"), F.left(digits, F.lit(15))), F.concat_ws("_", word(1), word(2), word(3), F.lit("2")), F.concat_ws("/", word(1), word(2), word(3), word(4)), F.concat(F.repeat(F.lit("A"), 20), F.lit("1"))]
    stand_ins = [F.lit("changeme1"), F.lit("your_token_goes_here_1"), F.lit("xxxxxxxxxxxxxxxxxxxx"), F.concat_ws("_", F.lit("example"), word(1), F.lit("1")), word(2)]
    paths = [F.lit(x) for x in ("src/app.py", "config/prod.env", "README", "tests/test_app.py", "deploy/values.yaml")]
    pick = lambda items, at: F.element_at(F.array(*items), (F.pmod(F.floor(at), F.lit(len(items))) + 1).cast("int"))
    side = lambda pairs, j: [F.lit(p[j]) for p in pairs]
    rows = spark.range(n).select("id", (k % 2).alias("label"), F.floor(k / 2).alias("j"))
    j = F.col("j")
    stand_in = (F.col("label") == 0) & (j % 4 == 3)
    near = lambda c: F.when((F.col("label") == 1) | stand_in, pick(side(AROUND_SECRETS, c), j / len(keys))).otherwise(pick(side(AROUND_OTHERS, c), j / len(others)))
    secret = F.when(F.col("label") == 1, pick(keys, j)).when(stand_in, pick(stand_ins, j / 4)).otherwise(pick(others, j))
    return rows.select(secret.alias("secret"), near(0).alias("before"), near(1).alias("after"), pick(paths, j / 3).alias("path"), "label")
