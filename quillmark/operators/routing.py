"""Turns of a conversation: classes, consent, the question behind a confirmation, history and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.text import CODE_IN_TURN, fold, normal_turn, squeezed, strings
from quillmark.operators.guardrails import offers

SOCIAL_CHARS, FOLLOW_CHARS, CONSENT_CHARS = 45, 70, 64
#: Formulas of greeting, courtesy and farewell, and the patterns of each class of turn, in normal form.
GREETINGS = (
    "hola", "holaa", "ola", "buenas", "buenos dias", "buenas tardes", "buenas noches", "que tal", "que tal todo", "como estas", "como va", "como va todo",
    "que tal estas", "hey", "saludos", "buen dia", "buenas!", "hola que tal",
)
COURTESY = (
    "gracias", "muchas gracias", "mil gracias", "ok gracias", "vale gracias", "perfecto gracias", "genial gracias", "ok", "vale", "perfecto", "entendido",
    "de acuerdo", "genial", "excelente", "muy bien",
)
FAREWELLS = ("adios", "hasta luego", "chao", "chau", "nos vemos", "hasta pronto", "bye", "hasta manana", "buenas noches gracias")
META = (
    r"\bque (puedes|sabes) hacer\b", r"\ben que (me )?(puedes )?ayuda", r"\bquien eres\b", r"\bcomo funcionas\b", r"\bque eres\b", r"\bpara que sirves\b",
    r"\bde que (tienes certeza|puedes hablar|hablas)\b", r"\bque (documentos|documentacion) (tienes|manejas|cubres|conoces)\b", r"\bestan versionad",
    r"\bque versiones (hay|tienes|tienen)\b", r"\btienes (informacion de )?la v\d", r"\bcuantos documentos\b", r"\bque (areas|tipos de documento)\b", r"\bayuda\b$",
)
PRODUCTION = (
    r"\b(haz|hazme|crea|crear|creame|genera|generame|disena|disename|elabora)\b.{0,40}\b(cartel|carteles|afiche|poster|imagen|imagenes|senaletica|senalizacion|lamina|laminas|infografia|material visual|grafico)\b",
    r"\b(cartel|afiche|poster|senaletica|infografia)\b.{0,30}\b(para|sobre|de)\b", r"\bmaterial (visual|de concienciacion|de induccion)\b", r"\bnecesito un (cartel|afiche|poster)\b",
)
INJECTION = (r"\bignora (tus|las|todas) ", r"\bolvida (lo anterior|todo|tus|tus reglas)", r"\bnuevas instrucciones\b", r"\bactua como\b", r"\bsystem prompt\b", r"\bsin importar (tus|las) reglas\b")
INSTRUCTION = (
    r"^responde (siempre |solo |unicamente )?(en|con)\b", r"^(habla|escribe|contesta) (siempre |solo )?(en|con)\b", r"\bno (me )?(cites|menciones|uses)\b",
    r"\b(se|sé) (mas |menos )?(breve|formal|informal|tecnico|conciso)\b", r"^(usa|utiliza) (un )?(tono|lenguaje)\b",
)
FOLLOW_CLEAR = (
    r"^(si|sip|claro|dale|adelante|correcto|por supuesto)([, ]+(por favor|claro|gracias|adelante))?$", r"^(no|nop|no gracias|mejor no)$",
    r"\b(mas (corto|breve|largo|detalle|detallado)|resumelo|resumemelo|amplia|explicalo mejor|otra vez|de nuevo)\b", r"\b(en (una )?tabla|en (una )?lista|con vinetas|en puntos|en bullets)\b",
    r"\bno,? me refer", r"\bno es (eso|correcto|lo que)\b", r"\beso no es lo que dice\b", r"\bque te pregunte\b",
)
FOLLOW_WEAK = (
    r"^(y|pero|entonces|ademas|tambien) ", r"\bla anterior\b", r"\b(leelo|leela|el completo|la completa)\b", r"^(ya )?(lo|la) (tienes|creaste|generaste|hiciste|terminaste|acabaste)\b",
    r"^(lo|la) (estas) (creando|generando|haciendo|preparando)\b", r"^(ya )?(esta) (listo|lista|terminado|terminada|generado|generada)\b", r"^(sigues|estas) (ahi|trabajando)\b", r"^(falta|cuanto falta|tarda mucho)\b",
)
DOMAIN = (
    r"\b(documento|documentos|manual|manuales|politica|politicas|procedimiento|procedimientos|instructivo|formato|formatos|registro|clausula|seccion|apartado|norma|iso|version|vigente|obsoleto|plazo|plazos|"
    r"tiempo|tiempos|responsable|alcance|objetivo|requisito|requisitos|auditoria|calidad|conformidad|hallazgo|correctiva|proveedor|proveedores|compras|contrasena|contrasenas|respaldo|seguridad|solicitud|"
    r"solicitudes|incidencia|equipo|equipos)\b"
)
YES = (
    r"^(s[ií]+|sip|sipi|claro|dale|ok|oka|okey|vale|bueno|listo|correcto|exacto|afirmativo|dalee|porfa|please|yes|ya|dalo|hazlo|hagalo|adelante|dele|de\s?acuerdo|me\s+parece|esta\s+bien|asi\s+es|por\s+favor|"
    r"(si|claro|ok|dale|bueno)\s+(por\s+favor|porfa|gracias|hazlo|dale|derivalo|escalalo)|(derivalo|escalalo|derivala|escalala|mandalo|envialo|pasalo|consultalo|reportalo)|"
    r"(quiero|deseo|necesito|prefiero)\s+que\s+(lo|la|me\s+lo|me\s+la)\s*\w*)$"
)
NO = (
    r"^(no+|nop|nope|negativo|paso|no\s+(gracias|hace\s+falta|es\s+necesario|por\s+ahora|todavia|aun|importa|hace\s+falta\s+gracias)|(mejor\s+)?no(\s+gracias)?|"
    r"(dejalo|olvidalo|cancela|cancelalo|anulalo|ya\s+no|despues|luego|mas\s+tarde|otro\s+dia|no\s+lo\s+derives|no\s+lo\s+escales)(\s+\w+)?)$"
)
REPLIES = {
    "saludo": "¡Hola! Respondo sobre la documentación ISO vigente de la organización, citando siempre el documento y la sección. ¿Qué necesitas consultar?",
    "cortesia": "¡A ti! Si te surge otra consulta sobre la documentación, aquí estoy.",
    "despedida": "Hasta luego. Vuelve cuando necesites consultar algo del sistema de gestión de calidad.",
    "saludo_repetido": "Aquí sigo. Dime qué necesitas consultar de la documentación.",
}


def any_of(patterns: tuple[str, ...]) -> str:
    return "|".join(patterns)


def social_class(message: Column) -> Column:
    """saludo, cortesia, despedida or null: all segments are formulas, and the last one tells the class."""
    n = normal_turn(message)
    parts = F.filter(F.split(n, r"\s*(?:,|\.|;|\by\b)\s*"), lambda p: p != "")
    known = F.forall(parts, lambda p: p.isin(*GREETINGS, *COURTESY, *FAREWELLS))
    last = F.element_at(F.when(F.size(parts) > 0, parts), -1)
    kind = F.when(last.isin(*FAREWELLS), "despedida").when(last.isin(*COURTESY), "cortesia").otherwise("saludo")
    return F.when((n != "") & (F.length(n) <= SOCIAL_CHARS) & (F.size(parts) > 0) & known, kind)


def turn_class(message: Column, has_previous: Column) -> Column:
    """social, documental, produccion, meta or conversacional; documental in doubt."""
    n = normal_turn(message)
    follow = has_previous & (F.length(n) <= FOLLOW_CHARS) & (n.rlike(any_of(FOLLOW_CLEAR)) | n.rlike(any_of(FOLLOW_WEAK)) & ~n.rlike(DOMAIN))
    produces = n.rlike(any_of(PRODUCTION))
    return (
        F.when(social_class(message).isNotNull(), "social").when((n == "") | n.rlike(CODE_IN_TURN) & ~produces, "documental").when(produces, "produccion").when(n.rlike(any_of(META)), "meta")
        .when(n.rlike(any_of(INJECTION)), "documental").when(n.rlike(any_of(INSTRUCTION)) | follow, "conversacional").otherwise("documental")
    )


def with_previous(turns: DataFrame) -> DataFrame:
    """Adds has_previous to turns (id, conversation_id, ...)."""
    return turns.withColumn("has_previous", F.row_number().over(Window.partitionBy("conversation_id").orderBy("id")) > 1)


def social_replies(turns: DataFrame) -> DataFrame:
    """Adds social and reply to turns (id, conversation_id, content); a second greeting in a conversation gets the short one."""
    t = turns.withColumn("social", social_class(F.col("content")))
    before = F.max(F.coalesce(F.col("social") == "saludo", F.lit(False))).over(Window.partitionBy("conversation_id").orderBy("id").rowsBetween(Window.unboundedPreceding, -1))
    key = F.when((F.col("social") == "saludo") & before, "saludo_repetido").otherwise(F.col("social"))
    replies = F.create_map(*(F.lit(x) for kv in REPLIES.items() for x in kv))
    return t.withColumn("reply", replies[key])


def consent(message: Column) -> Column:
    """true, false, or null where a message neither accepts nor declines."""
    n = squeezed(F.regexp_replace(normal_turn(message), r"[,;.!?]+", " "))
    short = (normal_turn(message) != "") & (F.length(normal_turn(message)) <= CONSENT_CHARS)
    return F.when(short & n.rlike(YES), True).when(short & n.rlike(NO), False)


def resolve_consent(messages: DataFrame, escalations: DataFrame) -> DataFrame:
    """(id, escalation_id, status): user messages that answer an offer, with the latest proposal of their conversation and what becomes of it."""
    w = Window.partitionBy("conversation_id").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("role") == "assistant", F.col("content")), ignorenulls=True).over(w)
    m = messages.withColumn("last", last).filter((F.col("role") == "user") & offers(F.col("last"))).withColumn("answer", consent(F.col("content"))).filter("answer IS NOT NULL")
    p = escalations.filter("status = 'propuesta'").groupBy("conversation_id").agg(F.max("id").alias("escalation_id"))
    return m.join(p, "conversation_id").select("id", "escalation_id", F.when(F.col("answer"), "pendiente").otherwise("descartada").alias("status"))


def useful_questions(messages: DataFrame) -> DataFrame:
    """(id, question) of user messages: the message, or for a mere confirmation the latest of the six messages before it that is none."""
    u = messages.filter("role = 'user'").withColumn("text", F.trim(F.coalesce("content", F.lit(""))))
    before = F.collect_list("text").over(Window.partitionBy("conversation_id").orderBy("id").rowsBetween(-6, -1))
    u = u.withColumn("real", F.filter(before, lambda t: consent(t).isNull() & (t != "") & (t != F.col("text"))))
    own = (F.col("text") != "") & consent(F.col("text")).isNull()
    back = F.when(F.size("real") > 0, F.element_at("real", -1))
    return u.select("id", F.when(own, F.col("text")).otherwise(F.coalesce(back, F.nullif("text", F.lit("")), F.lit("(sin registrar)"))).alias("question"))


def history(messages: DataFrame, n: int = 6) -> DataFrame:
    """The last n messages of every conversation, place 1 for the oldest of them."""
    w = Window.partitionBy("conversation_id")
    m = messages.withColumn("back", F.row_number().over(w.orderBy(F.desc("id")))).filter(F.col("back") <= n)
    return m.withColumn("place", F.row_number().over(w.orderBy("id"))).drop("back")


def new_conversations(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """Distinct (tenant_id, channel, external_user_id) of messages that have no conversation yet."""
    key = ["tenant_id", "channel", "external_user_id"]
    return messages.select(*key).distinct().join(conversations, key, "left_anti")


def prompts(turns: DataFrame, default_prompt: str, today: str) -> DataFrame:
    """(id, messages): system prompt, question block, context or its absence, limits with the date, history, user text.

    turns: id, system_prompt, faq_block, context_block, history (array of role and content), content, produces.
    """
    m = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    hint = F.lit(f"\n\nRecuerda: no apruebas ni modificas documentos. HOY es {today}.")
    context = F.when(F.col("context_block").isNull(), F.concat(F.lit("No se recupero ningun fragmento. No inventes."), hint)).otherwise(F.concat(F.lit("Fragmentos VIGENTES recuperados:\n\n"), F.col("context_block"), hint))
    parts = F.array(
        m("system", F.coalesce("system_prompt", F.lit(default_prompt))), F.when(F.col("faq_block").isNotNull(), m("system", F.concat(F.lit("Preguntas frecuentes parecidas:\n\n"), F.col("faq_block")))),
        m("system", context), F.when(F.col("produces"), m("system", F.lit("Se pide producir material visual."))),
    )
    return turns.select("id", F.concat(F.filter(parts, lambda x: x.isNotNull()), "history", F.array(m("user", F.col("content")))).alias("messages"))


#: Terms that are never drawn, forms that carry letters, Spanish function words, nouns in -ing.
BANNED = (
    "nude", "nudity", "naked", "desnudo", "desnuda", "erotic", "erotico", "weapon", "gun", "rifle", "arma", "pistola", "fusil", "child", "children", "minor", "nino", "nina", "menor",
    "gore", "blood", "sangre", "corpse", "cadaver",
)
LETTERED = (
    "infographic", "infographics", "chart", "charts", "graph", "graphs", "diagram", "diagrams", "poster", "posters", "banner", "banners", "signage", "billboard", "slide", "slides", "presentation",
    "label", "labels", "caption", "captions", "headline", "heading", "title", "titles", "subtitle", "text", "typography", "lettering", "bullet", "bullets", "checklist", "infocard", "leaflet", "brochure",
)
SPANISH = ("el", "la", "los", "las", "un", "una", "unos", "unas", "de", "del", "en", "con", "sin", "sobre", "para", "por", "que", "y", "o", "su", "sus", "al", "este", "esta", "junto", "mientras", "donde", "dos", "tres")
ING_NOUNS = ("building", "ceiling", "clothing", "lighting", "shelving", "packaging", "thing", "nothing", "morning", "evening", "training")


def banned_terms(c: Column) -> Column:
    """Banned words of a description, plain or as a simple plural, in the spelling they were written in."""
    words = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[\p{L}]+"), F.lit(0)), lambda w: F.lower(w)))
    bad = strings(BANNED)
    hit = lambda w: F.array_contains(bad, fold(w)) | fold(w).endswith("s") & F.array_contains(bad, F.regexp_replace(fold(w), "s$", "")) | fold(w).endswith("es") & F.array_contains(bad, F.regexp_replace(fold(w), "es$", ""))
    return F.array_sort(F.filter(words, hit))


def lettered_terms(c: Column) -> Column:
    words = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[A-Za-z]+"), F.lit(0)), lambda w: F.lower(w))
    return F.array_sort(F.array_intersect(words, strings(LETTERED)))


def looks_spanish(c: Column) -> Column:
    low = F.lower(c)
    return low.rlike("[áéíóúñ¿¡]") | (F.size(F.array_intersect(F.regexp_extract_all(low, F.lit("[a-záéíóúñ]+"), F.lit(0)), strings(SPANISH))) >= 2)


def has_action(c: Column) -> Column:
    words = F.transform(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: F.lower(F.regexp_replace(w, r"^[.,;:]+|[.,;:]+$", "")))
    return F.exists(words, lambda w: w.endswith("ing") & ~w.isin(*ING_NOUNS))


def validate_material(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """Adds error to requests (id, tenant_id, description, clause): out of scope, lettered, without a code, or with one not in force."""
    from quillmark.functions.text import base_code, cited_codes

    r = requests.withColumn("codes", cited_codes(F.col("clause")))
    known = documents.filter("status = 'vigente'").select("tenant_id", base_code(F.col("code")).alias("code")).distinct()
    missing = r.select("id", "tenant_id", F.explode("codes").alias("code")).join(known, ["tenant_id", "code"], "left_anti").select("id").distinct().withColumn("missing", F.lit(True))
    error = F.when(F.size(banned_terms(F.col("description"))) > 0, "fuera_de_alcance").when(F.size(lettered_terms(F.col("description"))) > 0, "pide_texto").when(F.size("codes") == 0, "sin_respaldo").when(F.col("missing"), "codigo_inexistente")
    return r.join(missing, "id", "left").withColumn("error", error).drop("codes", "missing")
