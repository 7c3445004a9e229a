"""Correction of recognised words against a vocabulary.

Decided on distinct tokens by joins with small tables of fixed size, in this order: short words and such
with digits stay; known confusions; known words get their accents; one letter replaced; one
letter left out on both sides (neighbours swapped, for one). Of several candidates the first word of the
vocabulary wins.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.functions import text as tx

# The vocabulary, in order.
WORDS = """
fecha gestion orden regimen numero codigo cantidad total observacion observaciones descripcion detalle consecutivo documento
identificacion cedula expedicion vencimiento registro vigencia resolucion formulario autorizacion radicado solicitud aprobado
tramite auditoria impresion transcribe funcionario auxiliar administrativo responsable firma usuario externo interno
paciente nombre nombres apellidos primer segundo sexo edad nacimiento direccion telefono celular correo electronico municipio
ciudad departamento pais zona barrio localidad afiliado
diagnostico medico especialista prestador clinica hospital salud entidad primaria cooperativa asociado integral sociedad habilitacion
procedimiento procedimientos examen examenes estudio laboratorio ecocardiograma transtoracico electrocardiograma electrocardiografico
monitoreo continuo holter consulta urgencias hospitalizacion terapia tratamiento cirugia medicamento medicamentos dosis
losartan hidroclorotiazida hidroxido aluminio previsalud semedical ceminsa coosalud sabanalarga
factura proveedor cliente empresa subtotal descuento impuesto retencion valor pagar pagado saldo banco cuenta corriente
ahorros tarjeta efectivo transferencia precio unitario pesos
enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre lunes martes miercoles
jueves viernes sabado domingo hora minuto dias meses anos
""".split()

# Words with a form of their own, by that form.
FORMS = """
Fecha Gestión Orden Régimen Número Código Observación Observaciones Descripción Identificación Cédula Expedición Resolución
Autorización Auditoría Impresión Paciente Dirección Teléfono Electrónico Diagnóstico Médico Habilitación ecocardiograma
transtorácico electrocardiograma electrocardiográfico cirugía miércoles sábado años Auxiliar Administrativo externo
Transcribe Prestador Municipio Previsalud Semedical Losartán Hidroclorotiazida Hidróxido CEMINSA COOSALUD Sabanalarga
""".split()

# Known confusions, each with what is meant.
CONFUSIONS = """
facha fecha
gestlon gestion
disgnostico diagnostico
paclente paciente
extemo externo
extermo externo
transtoracico transtoracico
consanuo consalud
consaquo consalud
consaduo consalud
fiduprevisora fiduprevisora
transcribe transcribe
auxlllar auxiliar
administratlvo administrativo
emedica semedical
semedica semedical
sermedica semedical
somedia semedical
somedical semedical
comarcal semedical
comorira semedical
comedical semedical
provicalur previsalud
previaalud previsalud
sartan losartan
lojartan losartan
droclorotiazida hidroclorotiazida
hidrocloratiazida hidroclorotiazida
droxido hidroxido
""".strip().splitlines()


@lru_cache(1)
def _forms() -> dict[str, str]:
    return {tx.plain_form(f): f for f in FORMS}


def form_of(word: str) -> str:
    return _forms().get(word, word)


def known(spark: SparkSession) -> DataFrame:
    """word, ord, form, has_form."""
    return spark.createDataFrame([(w, i, form_of(w), w in _forms()) for i, w in enumerate(WORDS)], "word string, ord int, form string, has_form boolean")


def confusions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(bad, form_of(good)) for bad, good in map(str.split, CONFUSIONS)], "bad string, form string")


def shortened(spark: SparkSession) -> DataFrame:
    """short, form: each word of the vocabulary less one letter; of equal ones the first."""
    first: dict[str, str] = {}
    for w in WORDS:
        for i in range(len(w)):
            first.setdefault(w[:i] + w[i + 1 :], w)
    return spark.createDataFrame([(s, len(w), form_of(w)) for s, w in first.items()], "short string, length int, form string")


def patterns(x: Column) -> Column:
    """The word with each letter in turn masked: words of one pattern differ there at most."""
    return F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.lit("\u0001"), F.substring(x, i + 1, F.length(x))))


def corrections(tokens: DataFrame) -> DataFrame:
    """token, corrected, step (0 for what stays) of every distinct token."""
    spark = tokens.sparkSession
    own = tokens.select("token").filter("token IS NOT NULL").distinct().withColumn("clean", tx.normal(F.col("token")))
    open_ = (F.length("token") >= 4) & ~F.col("token").rlike(r"\p{Nd}|[²³¹⁰-⁹₀-₉]")
    words = known(spark)
    # small tables of fixed size: 151 words, 29 confusions, and their variants
    direct = F.broadcast(confusions(spark).select("bad", F.col("form").alias("form1")))
    exact = F.broadcast(words.select(F.col("word").alias("word2"), F.when(F.col("has_form"), F.col("form")).alias("form2")))
    masks = words.select(F.explode(patterns(F.col("word"))).alias("mask"), "ord", "form")
    cut = F.broadcast(shortened(spark).select("short", "length", F.col("form").alias("form4")))
    base = own.filter(open_).join(direct, F.col("clean") == F.col("bad"), "left").join(exact, F.col("clean") == F.col("word2"), "left")
    rest = base.filter("bad IS NULL AND word2 IS NULL").select("token", "clean")
    one = rest.select("token", F.explode(patterns(F.col("clean"))).alias("m")).join(F.broadcast(masks), F.col("m") == F.col("mask")).groupBy("token").agg(F.min_by("form", "ord").alias("form3"))
    less = rest.select("token", "clean", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("clean")), lambda i: F.concat(F.substring("clean", F.lit(1), i - 1), F.substring("clean", i + 1, F.length("clean"))))).alias("at", "gone"))
    swapped = less.join(cut, F.col("gone") == F.col("short")).filter(F.abs(F.col("length") - F.length("clean")) <= 1).groupBy("token").agg(F.min_by("form4", "at").alias("form4"))
    told = base.join(one, "token", "left").join(swapped, "token", "left")
    step = F.when(F.col("bad").isNotNull(), 1).when(F.col("word2").isNotNull(), F.when(F.col("form2").isNotNull(), 2).otherwise(0)).when(F.col("form3").isNotNull(), 3).when(F.col("form4").isNotNull(), 4).otherwise(0)
    changed = told.withColumn("step", step).select("token", F.when(F.col("step") == 0, F.col("token")).otherwise(tx.cased_like(F.col("token"), F.when(F.col("step") == 0, F.lit("")).otherwise(F.try_element_at(F.array("form1", "form2", "form3", "form4"), F.nullif("step", F.lit(0)))))).alias("corrected"), "step")
    return changed.unionByName(own.filter(~open_).select("token", F.col("token").alias("corrected"), F.lit(0).alias("step")))


def cleaned(texts: DataFrame) -> DataFrame:
    """id, text -> id, text: lines without noise, with corrected words. Null gives an empty text."""
    pieces = texts.select("id", F.posexplode_outer(tx.kept_lines(F.col("text"))).alias("line", "body")).select("id", "line", F.posexplode_outer(tx.with_separators(F.col("body"))).alias("at", "piece"))
    wordy = tx.is_alphabetic(F.col("piece")) & (F.length("piece") >= 4)
    fixed = corrections(pieces.filter(wordy).select(F.col("piece").alias("token"))).filter("step > 0").select(F.col("token").alias("t"), "corrected")
    # separators and short words, the commonest pieces by far, don't meet the corrections
    words = pieces.filter(wordy).join(fixed, F.col("piece") == F.col("t"), "left").withColumn("piece", F.coalesce("corrected", "piece"))
    joined = words.select("id", "line", "at", "piece").unionByName(pieces.filter(~F.coalesce(wordy, F.lit(False))).select("id", "line", "at", "piece"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("at", "piece")))), lambda p: p["piece"]), "")
    rows = joined.groupBy("id", "line").agg(tx.squeezed(tx.stripped(line)).alias("body"))
    whole = F.array_sort(F.collect_list(F.when(F.coalesce("body", F.lit("")) != "", F.struct("line", "body"))))
    return rows.groupBy("id").agg(F.array_join(F.transform(whole, lambda r: r["body"]), "\n").alias("text"))


def corrected_words(words: DataFrame) -> DataFrame:
    """words with an array ``corrected`` for recognised ones: normal forms of corrections of the cleaned word and of its parts, where they differ from what they correct."""
    clean = tx.trimmed_word(tx.normal(F.col("word")))
    asked = words.withColumn("_asked", F.when(F.col("src") != "text", F.concat(F.array(clean), F.filter(tx.word_parts(clean), lambda t: (t != clean) & (F.length(t) >= 2)))).otherwise(F.array().cast("array<string>")))
    fixed = corrections(asked.select(F.explode("_asked").alias("token"))).filter("step > 0").select(F.col("token").alias("t"), tx.normal(F.col("corrected")).alias("corrected")).filter("corrected <> t")
    each = asked.select("doc_id", "page", "src", "image_id", "seq", F.posexplode("_asked").alias("at", "token")).join(fixed, F.col("token") == F.col("t"))
    own = each.groupBy("doc_id", "page", "src", "image_id", "seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "corrected"))), lambda c: c["corrected"]).alias("corrected"))
    keys = ["doc_id", "page", "src", "image_id", "seq"]
    renamed = own.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return asked.join(renamed, same, "left").withColumn("corrected", F.coalesce("corrected", F.array().cast("array<string>"))).drop("_asked", *(f"_{k}" for k in keys))
