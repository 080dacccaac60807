"""What words in calls and in artists' documents tell: our own vocabulary, in English and some German, French and Spanish.

Each row is (template, effect, topic); ``(a|b|)`` in a template stands for a choice, ``#`` for a number. The
tables are small and fixed; ``table`` gives a layer as a DataFrame, ``said`` a column of its cues.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession

from callweave.operators.phrases import expand, reader

Row = tuple[str, str, str | None]


def _rows(effect: str, topic: str | None, *templates: str) -> list[Row]:
    return [(t, effect, topic) for t in templates]


TOPIC = [
    *_rows("TOPIC", "AGE", "(#|) years old", "(age|aged|ages)", "(under|over|below|above) (the age of|) #", "born (in|after|before|between)", "of legal age", "adults", "minors", "jahre alt", "alter", "altersgrenze", "volljährig", "âge", "âgés", "ans", "edad", "años", "mayores"),
    *_rows("TOPIC", "RESIDENCE", "based in", "based outside", "(resident|residents|residence|residency status)", "(reside|resides|residing)", "(live|lives|living) (in|outside)", "place of residence", "domiciled", "wohnhaft", "wohnsitz", "résidant", "domiciliés", "residentes", "residir"),
    *_rows("TOPIC", "NATIONALITY", "(citizen|citizens|citizenship)", "(national|nationals|nationality|nationalities)", "(passport|passports)", "staatsangehörigkeit", "nationalité", "nacionalidad", "ciudadanos"),
    *_rows("TOPIC", "APPLICANT_TYPE", "(individual|individuals)", "(group|groups|duo|duos|trio|ensemble|ensembles)", "(collective|collectives)", "(organisation|organisations|organization|organizations)", "(association|associations|institution|institutions)", "legal (entity|entities|person|persons)", "natural (person|persons)", "einzelpersonen", "gruppen", "vereine", "kollektive", "collectifs", "colectivos", "personas físicas"),
    *_rows("TOPIC", "STUDENT_STATUS", "(student|students)", "(enrolled|enrolment|enrollment)", "(graduate|graduates|graduated|graduation)", "alumni", "studierende", "étudiants", "estudiantes"),
    *_rows("TOPIC", "EDUCATION", "(degree|degrees|diploma|diplomas)", "(bachelor|bachelors|bachelor s)", "master s", "university education", "higher education", "hochschulabschluss", "diplôme", "titulación"),
    *_rows("TOPIC", "CAREER_STAGE", "emerging", "early career", "mid career", "established (artist|artists)", "(newcomer|newcomers)", "years of (professional|artistic|) (practice|experience|work)", "nachwuchs", "berufserfahrung", "artistes émergents", "artistas emergentes"),
    *_rows("TOPIC", "PRIOR_FUNDING", "(previously|already|before) (received|funded|awarded|supported)", "(received|been awarded) a grant", "won before", "bereits gefördert", "déjà bénéficié"),
    *_rows("TOPIC", "GENERIC", "must", "only", "eligible", "required", "(may|can) apply", "open to", "conditions", "voraussetzung", "teilnahmeberechtigt", "peuvent postuler", "pueden presentarse"),
]

FORCE = [
    *_rows("WAIVES", "AGE", "no (upper|lower|maximum|minimum|) age (limit|limits|restriction|restrictions|requirement)", "(of|at) (any|every) age", "of all ages", "(regardless|irrespective|independent) of (their|your|) age", "whatever (their|your) age", "age (is|does) not (important|matter|relevant)", "keine altersgrenze", "ohne altersgrenze", "sans limite d âge", "sin límite de edad"),
    *_rows("WAIVES", "NATIONALITY", "(any|every) nationality", "all nationalities", "(regardless|irrespective|independent) of (their|your|) (nationality|citizenship|passport|origin)", "not (need|have) to be (a|) (citizen|citizens|national|nationals)", "unabhängig von (ihrer|der) nationalität", "toutes les nationalités", "todas las nacionalidades"),
    *_rows("WAIVES", "RESIDENCE", "(regardless|irrespective|independent) of (where they live|where you live|residence|place of residence|their residence|location)", "wherever (they|you) live", "from anywhere"),
    *_rows("WAIVES", None, "open to (all|everyone|everybody|anyone)", "no (specific|special|particular|formal|) (requirement|requirements|restriction|restrictions|condition|conditions|prerequisite)", "(is|are) not (required|necessary|needed|mandatory|compulsory)", "not (need|have) to", "need not", "nicht (erforderlich|notwendig)", "no es necesario", "n est pas nécessaire"),
    *_rows("EXCLUDES", None, "not (be|) (eligible|accepted|admitted|considered|allowed|permitted|entitled|granted|funded|supported)", "ineligible", "(cannot|can not|can t|may not|must not|shall not|mustn t)", "(is|are|be|being) excluded", "excludes", "(does|do) not accept", "(is|are) not studying", "not or no longer", "(should|must|can|may) instead apply", "(apply|turn) instead", "nicht (zugelassen|berechtigt|gefördert)", "ausgeschlossen", "ne peuvent pas", "no pueden", "quedan excluidos"),
    *_rows("HARMLESS", None, "not (only|just|limited to|restricted to|confined to)", "(we|organisers|the host|the residency) (cannot|can not|can t|do not|don t) (offer|provide|pay|cover|reimburse|arrange)", "(must not|may not|cannot|can not) (exceed|be higher than|be more than|be larger than|be longer than|be later than|be older than)", "nicht nur"),
    *_rows("SOFTENS", None, "(usually|normally|typically|exceptionally)", "as a rule", "in principle", "(if|where|whenever) possible", "in (exceptional|special|rare|justified) cases", "in der regel", "grundsätzlich", "en principe", "por lo general"),
    *_rows("DEPENDS", None, "(except|excepting|excluding|unless)", "(exception|exceptions)", "provided (that|they|you)", "as long as", "on (the|) condition (that|of)", "es sei denn", "sauf", "excepto", "salvo"),
    *_rows("DEMANDS", None, "(must|should|only|exclusively|required|mandatory)", "(have|has|need|needs) to", "obliged to", "(is|are) eligible", "(is|are|) open to", "müssen", "doivent", "deben", "ausschließlich"),
]

AIM = [
    *_rows("DEFINES", None, "(is|are) (understood|defined|considered|regarded|meant|counted) as", "(we|by this we) mean", "is not a (condition|requirement|criterion)", "for the purposes of this call", "unter nachwuchs verstehen wir"),
    *_rows("CHOSEN", None, "(selected|chosen|winning|successful|awarded|invited) (artist|artists|applicant|applicants|participant|participants|candidate|candidates|resident|residents|project|projects)", "the (winner|winners|recipient|recipients|grantee|grantees|fellow|fellows)"),
    *_rows("DUTY", None, "will (give|hold|present|receive|be asked|be expected|stay|work|take part)", "(is|are) expected to", "shall", "will"),
    *_rows("DUTY_ALONE", None, "must (attend|take part in|be present|submit a report|submit a final report|deliver)", "we expect", "(on|upon|after) selection"),
    *_rows("PROJECT", None, "(the|all|each|every|your|their|proposed|submitted|) (project|projects|work|works|artwork|artworks|proposal|proposals|production|productions|event|events|activity|activities|budget|budgets|partner|partners)", "projekte", "les projets", "los proyectos"),
    *_rows("PROJECT_HEADING", None, "partners can include", "eligible (projects|works|costs|activities|expenses)", "(project|technical|budget) (requirements|criteria)", "what we (fund|support)"),
    *_rows("PERSON", None, "(artwork|artworks|project|projects|work|works|proposal|proposals|event|events) (by|of|from|featuring) (artist|artists|applicant|applicants|the applicant|makers)", "(applicant|applicants|applying|apply)", "(resident|residents|residing|based in|living in|live in)", "(citizen|citizens|national|nationals|nationality)", "(born|age|aged)", "(student|students|graduate|graduates)", "(individual|individuals|collective|collectives|organisation|organisations|organization|organizations)"),
    *_rows("PREFERS", None, "(prefer|prefers|preferred|preferably|preference|preferences)", "ideally", "priority (is|will be) given", "(especially|particularly|strongly|) (encouraged|encourages)", "we encourage", "(especially|particularly) (welcome|interested in)", "bevorzugt", "de préférence", "preferentemente"),
    *_rows("WIDENS", None, "(may|can) also (apply|be|submit)", "(is|are) also (welcome|eligible|accepted|invited)", "(is|are) welcome (to apply|)", "(regardless|irrespective|independent) of", "no (specific|special|particular|formal|) (restriction|restrictions|requirement|requirements|condition|conditions)", "of all (ages|stages|backgrounds|levels)", "ebenfalls", "également", "también"),
    *_rows("NARROWS", None, "(only|exclusively|must|required)", "not eligible", "ineligible", "(cannot|can not|may not)", "(is|are) excluded", "provided that"),
]

KIND = [
    *_rows("TYPE", "group", "(group|groups|collective|collectives|duo|duos|trio|trios|ensemble|ensembles)", "artist (pairs|couples)", "gruppen", "kollektive", "collectifs", "colectivos"),
    *_rows("TYPE", "individual", "(individual|individuals)", "natural (person|persons)", "(solo|single) (artist|artists|applicants)", "einzelpersonen", "personnes physiques", "personas físicas"),
    *_rows("TYPE", "organisation", "(organisation|organisations|organization|organizations)", "(institution|institutions|association|associations|company|companies|foundation|foundations)", "legal (entity|entities|person|persons)", "vereine", "institutionen", "personnes morales", "personas jurídicas"),
    *_rows("ENROLLED", None, "(student|students|enrolled)", "studierende", "étudiants", "estudiantes"),
    *_rows("SINCE", None, "within (the last|the past|last|) # (year|years) (of|after|from) (graduation|graduating|their graduation|your graduation)", "graduated (within|in|during) (the|) (last|past) # (year|years)", "(no|not) more than # (year|years) (since|after) graduation", "abschluss liegt höchstens # jahre"),
    *_rows("EARLY", None, "emerging", "early career", "(newcomer|newcomers)", "(beginning|start|outset) of (their|your|a|an artistic) career", "nachwuchs", "émergents", "emergentes"),
    *_rows("LATE", None, "established", "(renowned|acclaimed|recognised)", "etablierte", "confirmés", "consagrados"),
    *_rows("MIDDLE", None, "mid career"),
    *_rows("TRAINED", None, "professional", "professionals", "professionally", "professionelle", "professionnels", "profesionales"),
    *_rows("ANY_STAGE", None, "(any|all|every) (career|) (stage|stages|level|levels)", "(regardless|irrespective) of (career|experience|seniority)", "any stage of (their|your) career", "all stages of (their|your) career"),
    *_rows("PRACTICE", None, "(practice|practise|practising|practicing|experience|career|active|working|works)", "berufserfahrung", "expérience", "experiencia"),
    *_rows("NOT_OWN", None, "(organisation|organisations|organization|organizations|institution|institutions|company|companies|association)", "since graduation", "(is|was|be) founded", "(exist|exists|existed)"),
    *_rows("SPAN", None, "# # years", "# to # years", "between # and # years", "# bis # jahre", "de # à # ans"),
    *_rows("LEAST", None, "(at least|minimum|minimum of|a minimum of|more than|over) # years", "# years or more", "# or more years", "# years minimum", "mindestens # jahre", "au moins # ans", "al menos # años"),
    *_rows("MOST", None, "(no more than|not more than|at most|up to|less than|fewer than|maximum|a maximum of) # years", "# years or less", "# years at most", "höchstens # jahre", "moins de # ans"),
    *_rows("YEARS", None, "(year|years)"),
    *_rows("DEGREE", None, "(degree|degrees|diploma|diplomas|bachelor|bachelor s|master s)", "(higher|university|academic) education", "hochschulabschluss", "diplôme", "título universitario"),
    *_rows("IN_ART", None, "in (the|) (fine|visual|) (art|arts)", "(from|at) an (art|arts) (school|academy|university|college)", "art (school|academy|college) (degree|diploma)"),
    *_rows("DETAIL", None, "in (the|) (fine|visual|) (art|arts) (history|management|education)", "(phd|doctorate|doctoral)", "in (music|architecture|design|engineering|law|dance|film|curating)", "from (a|an|the)", "(recognised|recognized|accredited|equivalent|comparable)"),
]

SKILL = [
    *_rows("SKILL", None, "(proficient|proficiency)", "(fluent|fluently|fluency)", "(good|working|excellent|basic|) (command|knowledge) of", "(speak|speaks|spoken|speaking)", "language skills", "mother tongue", "sprachkenntnisse", "maîtrise", "dominio"),
    *_rows("OF_WORK", None, "(translated|translation|translations|translator)", "(written|published|filled|presented|performed) in", "(submit|submitted|submission|submissions)", "(text|texts|documents|applications|works) in", "into"),
    *_rows("WISH", None, "(is|are) not (essential|required|necessary|needed)", "no (requirement|condition)", "(advantage|advantageous|asset|desirable|plus|bonus)", "(welcome|preferred|preferably|ideally|helpful)", "von vorteil"),
    *_rows("BELOW", None, "(basic|basics|beginner|beginners|elementary|rudimentary|learning|some)", "(a1|a2|b1)", "grundkenntnisse", "notions"),
]

DOCUMENT = [
    *_rows("WORKS", "exhibition", "(solo|selected|recent|) (exhibition|exhibitions|show|shows|screening|screenings)", "ausstellungen", "expositions", "exposiciones"),
    *_rows("WORKS", "performance", "(performance|performances|concert|concerts)", "auftritte", "conciertos"),
    *_rows("WORKS", "work", "(selected|recent|) (works|projects|project|productions|production)", "projekte", "œuvres", "obras"),
    *_rows("WORKS", "commission", "(commission|commissions)", "public art"),
    *_rows("TOGETHER", None, "group (exhibition|exhibitions|show|shows|projects|works)", "(group|collective)"),
    *_rows("CAREER", None, "(residency|residencies|award|awards|prize|prizes|grant|grants|fellowship|fellowships|publication|publications|festival|festivals)", "stipendien", "preise", "résidences", "becas"),
    *_rows("STUDIES", None, "(education|studies|training|degree|degrees|ausbildung|formation|formación)"),
    *_rows("LIVES", None, "(lives|live|living) (and works|and working|and work|) in", "(resides|residing|resident) in", "wohnt in", "lebt und arbeitet in", "vive y trabaja en", "vit et travaille à"),
    *_rows("BASED", None, "(is|) based in"),
    *_rows("MAKING", None, "(i am|i m|we are) (now|currently|) (making|developing|preparing|writing|filming|building|working on)", "currently (making|developing|preparing|writing|working on)", "(work|works|project|) in progress"),
    *_rows("PLANNING", None, "my next (project|work|piece|film|book|show)", "(i|we) (plan|intend|hope|aim) to", "(i am|we are) planning", "i would like to (make|develop|create|build)"),
    *_rows("SPEAKER", "individual", "(individual|independent|solo|freelance) artist"),
    *_rows("SPEAKER", "group", "(we are|is) (a|an) (small|young|new|open|dance|music|theatre|) (collective|duo|trio|ensemble|group|band)"),
    *_rows("SPEAKER", "organisation", "(we are|is) (a|an) (small|young|new|registered|non profit|) (organisation|organization|association|foundation|institution)"),
]

LAYERS: dict[str, list[Row]] = {"topic": TOPIC, "force": FORCE, "aim": AIM, "kind": KIND, "skill": SKILL, "document": DOCUMENT}


def table(spark: SparkSession, layer: str) -> DataFrame:
    """``phrase, effect, topic``: the phrases of a layer."""
    return spark.createDataFrame([(p, e, t) for template, e, t in LAYERS[layer] for p in expand(template)], "phrase string, effect string, topic string")


@cache
def said(layer: str):
    """The column function that gives a text's cues of a layer."""
    return reader(LAYERS[layer])


def cues(layer: str, text: Column) -> Column:
    return said(layer)(text)
