"""Weak labels from keyword lists, and measures of predicted against given labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text, values

# Labels in order of priority, and their keywords.
PRIORITY = ["edital_selection", "award_result", "event", "research", "extension", "teaching", "institutional_management", "service_announcement", "other"]
KEYWORDS = {
    "edital_selection": ["edital", "editais", "seleção", "processo seletivo", "inscrição", "inscrições", "resultado", "convocação", "homologação", "retificação", "chamada pública", "vaga", "vagas", "bolsista", "professor substituto", "tutor"],
    "event": ["evento", "seminário", "palestra", "encontro", "reunião", "audiência", "workshop", "oficina", "jornada", "congresso", "semana acadêmica", "simpósio", "live"],
    "research": ["pesquisa", "pesquisador", "iniciação científica", "ciência", "projeto de pesquisa", "inovação", "patente", "tecnologia", "publicação científica"],
    "extension": ["extensão", "comunidade", "curso gratuito", "ação social", "projeto de extensão", "oficina para comunidade", "programa de extensão"],
    "teaching": ["ensino", "curso", "estudante", "aluno", "aula", "avaliação do MEC", "licenciatura", "bacharelado", "técnico", "formação"],
    "award_result": ["premiação", "prêmio", "medalha", "olimpíada", "conquista", "aprovado", "destaque", "resultado final", "classificação"],
    "institutional_management": ["reitoria", "conselho", "codir", "consepe", "posse", "nomeação", "portaria", "reunião ordinária", "gestão", "planejamento", "parceria institucional"],
    "service_announcement": ["comunicado", "suspensão", "expediente", "manutenção", "férias", "calendário", "funcionamento", "aviso"],
}


def plain_key(keyword: str) -> str:
    import unicodedata

    return " ".join("".join(c for c in unicodedata.normalize("NFKD", keyword) if not unicodedata.combining(c)).lower().split())


def weak_label(body: Column, keywords: dict[str, list[str]] = KEYWORDS, priority: list[str] = PRIORITY) -> Column:
    """(label, matches): the first label in order of priority that has a keyword in the text, else ``other``."""
    plain = {label: [plain_key(k) for k in words] for label, words in keywords.items()}

    def labelled(hits: Column) -> Column:
        first = F.get(F.filter(F.array(*map(F.lit, priority)), lambda p: F.map_contains_key(hits, p)), F.lit(0))
        return F.struct(F.coalesce(first, F.lit("other")).alias("label"), hits.alias("matches"))

    return text.let(text.let(text.text_key(body), lambda key: values.keyword_hits(key, plain)), labelled)


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(truth).cast("string").alias("truth"), F.col(predicted).cast("string").alias("predicted")).agg(F.count("*").alias("n"))


def by_class(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each label, given or predicted; 0 where undefined."""
    given = counts.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support"))
    said = counts.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("predicted_n"))
    right = counts.where("truth = predicted").select(F.col("truth").alias("label"), F.col("n").alias("hits"))
    rows = given.join(said, "label", "full").join(right, "label", "left").fillna(0)
    ratio = lambda a, b: F.when(F.col(b) == 0, 0.0).otherwise(F.col(a) / F.col(b))
    rows = rows.withColumns({"precision": ratio("hits", "predicted_n"), "recall": ratio("hits", "support")})
    f1 = F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return rows.select("label", F.round("precision", 4).alias("precision"), F.round("recall", 4).alias("recall"), F.round(f1, 4).alias("f1"), "support")


def summary(counts: DataFrame) -> DataFrame:
    """Accuracy, macro F1 and F1 weighted by support."""
    right = counts.agg((F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    f1 = by_class(counts).agg(F.avg("f1").alias("macro"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted"))
    return right.crossJoin(f1).select(F.round("accuracy", 4).alias("accuracy"), F.round("macro", 4).alias("macro_f1"), F.round("weighted", 4).alias("weighted_f1"))  # one row each
