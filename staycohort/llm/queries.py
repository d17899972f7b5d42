"""One query per operator, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staycohort.llm import (
    chat_tree,
    factorisation,
    hilbert,
    lattice,
    mixing,
    prefix_trie,
    quality_rules,
    recompression,
    simhash,
    spelling,
    trie_bpe,
    url_rules,
    warc,
)
from staycohort.llm.common import crc_of_id

#: Share of a language's good documents that the quality rules may reject, and the
#: probability that they reject more.
QUALITY_RISK, QUALITY_DOUBT = 0.04, 0.05

#: Sources are mixed in proportion to their size to this power.
MIXING_EXPONENT, MIXING_SEED = 0.7, "mix-1"

#: Words of a shingle, and most differing bits of two linked fingerprints.
SIMHASH_WIDTH, SIMHASH_LIMIT = 4, 4

BASE_URL_RULES = (
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
)
#: Blocked where no base rule speaks: hosts that name one of these between dots or hyphens
#: (gambling, adult, drugs, loans and schemes, pirated copies, link farms).
BLOCKED_HOST_WORDS = (
    "casino", "casinos", "poker", "roulette", "blackjack", "jackpot", "slots", "sportsbook",
    "betting", "free-bets", "bet365",
    "porn", "porno", "xxx", "hentai", "camgirls", "escort", "escorts", "nudes", "milf",
    "viagra", "cialis", "levitra", "tramadol", "xanax", "cheap-pills", "diet-pills", "online-pharmacy",
    "payday-loans", "quick-loans", "free-money", "easy-money", "get-rich", "forex-signals",
    "warez", "keygen", "serialz", "torrents", "free-movies", "cracked-software",
    "spam-farm", "link-farm", "buy-backlinks", "article-spinner", "free-traffic", "replica-watches",
)
#: ... and pages whose path has one of these segments: forms, shops' steps, feeds, server files.
BLOCKED_PATH_PARTS = (
    "login", "signin", "signup", "register", "logout", "password-reset", "unsubscribe",
    "cart", "checkout", "basket", "wishlist", "wp-login.php", "wp-admin", "wp-json",
    "xmlrpc.php", "cgi-bin", "feed", "rss.xml", "sitemap.xml", "robots.txt", "404.html",
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file lies; every executor has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    extra = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    path = tokenizer_file("byte_bpe_50k.json")
    return chat_tree.read_back(chat_tree.format_conversations(turns, path), path)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return quality_rules.verdicts(docs, labels, QUALITY_RISK, QUALITY_DOUBT)


def op3_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    pieces = lattice.load_pieces(tokenizer_file("piece_bpe_32k.model"))
    return lattice.scored(docs, crc_of_id() % 7 == 2, pieces)


def op4_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = F.coalesce(crc_of_id() % 3 == 1, F.lit(False))
    model = factorisation.fit(docs, labels.where(~held_out).select("doc_id", "quality"))
    return factorisation.scored(docs, model).select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def op5_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return recompression.remove_repeats(docs, joined=True).select(
        "doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256")
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return simhash.near_duplicates(docs, SIMHASH_WIDTH, SIMHASH_LIMIT).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def url_rule_list() -> list[url_rules.Rule]:
    base = [url_rules.prefix_rule(verdict, rule) for verdict, rule in BASE_URL_RULES]
    hosts = [url_rules.host_word_rule("block", word) for word in BLOCKED_HOST_WORDS]
    paths = [url_rules.path_part_rule("block", part) for part in BLOCKED_PATH_PARTS]
    return base + hosts + paths


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_rules.judge_urls(
        _table(spark, sf_dir, "pages").select("page_id", "url"), url_rule_list(), otherwise="allow"
    )
    base = [rule for _, rule in BASE_URL_RULES]
    return judged.select(
        "page_id", "host", "path", F.when(F.col("rule").isin(base), F.col("rule")).alias("rule"), "verdict"
    )


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return mixing.poisson_mixture(docs, mixing.smoothed_weights(docs, MIXING_EXPONENT), MIXING_SEED)


def op9_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = trie_bpe.encode_and_decode(docs, tokenizer_file("word_bpe_49k.json"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, places=20)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    taken = F.crc32(conv.cast("string")) % 9
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"), conv - conv % 5, taken).drop("node")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(_table(spark, sf_dir, "documents"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archived(_table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {
    "op1_chat_tree": op1_chat_tree,
    "op2_quality_rules": op2_quality_rules,
    "op3_lattice_score": op3_lattice_score,
    "op4_factorisation_machine": op4_factorisation_machine,
    "op5_recompression": op5_recompression,
    "op6_simhash": op6_simhash,
    "op7_url_filters": op7_url_filters,
    "op8_source_mixing": op8_source_mixing,
    "op9_trie_bpe": op9_trie_bpe,
    "op10_hilbert_neighbours": op10_hilbert_neighbours,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_spelling": op12_spelling,
    "op13_warc": op13_warc,
}
