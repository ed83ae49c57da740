"""Spending-group labels and merchant keys as column expressions (no join, no shuffle, no UDF)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLANKS = " \t\n\r\f\v"


@dataclass(frozen=True)
class Rule:
    """One labelling rule: the first rule with a keyword inside the text names the group."""

    group: str
    keywords: tuple[str, ...]
    credits_only: bool = False


# The spending groups and their descriptions.
SPENDING_GROUPS = {
    "savings": "Round-up 'Rahakoguja' transfers and Easy Saver / own-account savings movements",
    "income": "Incoming money: salary and peer-to-peer reimbursements/refunds",
    "groceries": "Supermarkets and food shops",
    "dining": "Restaurants, cafes, fast food and food delivery",
    "transport": "Ride-hailing, taxis, public transport tickets and fuel",
    "travel": "Intercity buses, flights, hotels and bookings",
    "subscriptions": "Recurring digital subscriptions and app billing",
    "utilities": "Telecom, dormitory rent and household utilities",
    "leisure": "Gym, books, tickets, beauty and hobbies",
    "shopping": "Clothing, electronics and general retail",
    "health": "Pharmacies and medical services",
    "cash": "ATM cash withdrawals",
    "transfer": "Outgoing transfers to other people / external accounts",
    "other": "Uncategorised (fallback)",
}

# The ordered keyword rules. A keyword that contains another keyword of its own
# group can never change the outcome and is left out.
DEFAULT_RULES = (
    Rule("income", ("WISE PAYMENTS",), credits_only=True),
    Rule("savings", ("RAHAKOGUJASSE", "EASY SAVER", "TRANSFER BETWEEN OWN ACCOUNTS")),
    Rule("cash", ("SULARAHA",)),
    Rule("transfer", ("WISE", "TRUSTLY", "REVOLUT", "HOLM BANK", "PAYSERA", "PAYPAL")),
    Rule("subscriptions", (
        "SPOTIFY", "APPLE.COM/BILL", "NETFLIX", "YOUTUBE", "GOOGLE", "OPENAI",
        "CURSOR, AI POWERED IDE", "ICLOUD", "PATREON", "AUDIBLE", "DISNEY", "HBO", "MICROSOFT",
        "ADOBE", "TELEGRAM")),
    Rule("utilities", (
        "TELE2", "TELIA", "ELISA", "ELEKTRILEVI", "EESTI ENERGIA", "ULIOPILASKULA",
        "ÜLIÕPILASKÜLA", "TTU UE", "UTILITIES")),
    Rule("travel", (
        "OMIO", "FLIXBUS", "BOOKING", "BKG*", "HOTEL", "AIRBNB", "RYANAIR", "WIZZ", "LUFTHANSA",
        "AIRBALTIC", "CONTBUS", "QUINTA", "RCV -", "HOSTEL", "EXPEDIA", "TRIP.COM",
        "LUX EXPRESS", "DB AUTOMATEN", "DB VERTRIEB", "CAB 20", "MOBILLY",
        "MINIATUR WUNDERLAND")),
    Rule("transport", (
        "BOLT.EU", "TAXI", "TAKSI", "PILET.EE", "TALLINN.PILET", "OLEREX", "NESTE", "CIRCLE K",
        "ALEXELA", "PARKING", "PARKIMINE")),
    Rule("dining", (
        "KOHV", "CAFE", "RESTORAN", "RESTAURANT", "SUSHI", "KFC", "MCDONALD", "HESBURGER",
        "BURGER KING", "PIZZA", "DODO", "KEBAB", "SHAURMA", "SHAWARMA", "WOLT", "LIDO",
        "ST.VITUS", "ARAXES", "PANNKOOGIMAJA", "TIN BHAI", "VEERENNI", "BISTRO", "GRILL",
        "BURGIR", "MATSIMOKA", "DRINK", "BAR ", "PUB", "VAPIANO", "SUBWAY", "CHICKEN", "FOOD",
        "RAMEN", "CHOPSTICKS", "WAFFLE", "CAFFEINE", "COFFEE", "PAGARID", "SIGA LA VACA",
        "UMAMI", "GREEK", "CAJNICA", "APELSIN", "ROTERMANNI SHOK", "GRUUV", "BABU", "TARO",
        "FRISCHEM", "WANDELHALLE", "NOODLE", "DELICE")),
    Rule("groceries", (
        "RIMI", "LIDL", "MAXIMA", "PRISMA", "COOP", "SELVER", "TIPI POOD", "PROMO CASH",
        "BARBORA", "GROSSI", "R-KIOSK", "RKIOSK", "TOIDUPOOD", "KAUPLUS", "EDEKA", "EDK*",
        "WOOLWORTH")),
    Rule("health", (
        "APTE", "BENU", "CLINIC", "KLIINIK", "DENTAL", "HAMBA", "MEDICAL", "PHARMACY")),
    Rule("shopping", (
        "H&M", "H & M", "PEPCO", "NEW YORKER", "RESERVED", "JO MALONE", "PANDORA", "EURONICS",
        "HUMANA", "ZARA", "PULL&BEAR", "BERSHKA", "SPORTSDIRECT", "DECATHLON", "IKEA", "PIKO",
        "RAVELSOFT", "MKK*", "STORE", "SHOP", "APRANGA", "HOUSE KRISTIINE", "KLICK",
        "CROPPTOWN", "FLYING TIGER", "MCPAPER", "ALIEXPRESS", "K-RAUTA", "FUTPAL",
        "TOILET SERVICE", "AS LUX", "D3 ")),
    Rule("leisure", (
        "GYM", "FITNESS", "FIENTA", "TICKET", "PILET", "KINO", "CINEMA", "ART SALONG", "MUSEUM",
        "MUUSEUM", "SALOON", "SALON", "BEAUTY", "BOARD GAME", "STEAM", "LAUNDRY",
        "KULTUURIVABRIK", "RAAMAT", "KNIG")),
)

# The number that marks a card line in the details, and the code table of the panel.
CARD_MARK = "516737"
CODE_GROUPS = {
    "IC": "income", "PE": "income", "HH": "utilities", "IN": "utilities", "ST": "utilities",
    "LO": "transfer", "IO": "other",
}
OPERATION_GROUPS = {"WIC": "cash", "CCW": "cash", "ROB": "transfer"}
PANEL_GROUPS = ("income", "utilities", "transfer", "cash", "savings", "other")


def _stripped(col: Column) -> Column:
    return F.btrim(F.coalesce(col, F.lit("")), F.lit(BLANKS))


def add_labels(
    tx: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, out: str = "spending_group"
) -> DataFrame:
    """Ordered keyword rules over upper("counterparty || details"), then the sign and name fallbacks.

    Null texts count as empty.  The rules become one ``CASE`` expression, so labelling runs inside
    the scan stage.
    """
    text, amount = F.col("__text"), F.col("amount")
    label = None
    for rule in rules:
        hit = reduce(or_, [F.contains(text, F.lit(word)) for word in rule.keywords])
        if rule.credits_only:
            hit = (amount > 0) & hit
        label = F.when(hit, rule.group) if label is None else label.when(hit, rule.group)
    name, note = _stripped(F.col("counterparty")), _stripped(F.col("details"))
    card_line = F.startswith(note, F.lit("'")) | F.contains(note, F.lit(CARD_MARK))
    person = (name != "") & ~card_line & ~name.rlike(r"\p{Nd}")
    incoming, fallback = amount > 0, F.when(person, "transfer").otherwise("other")
    label = F.when(incoming, "income").otherwise(fallback) if label is None else (
        label.when(incoming, "income").otherwise(fallback)
    )
    joined = F.upper(F.concat_ws(" || ", *[F.coalesce(F.col(c), F.lit("")) for c in ("counterparty", "details")]))
    return tx.withColumn("__text", joined).withColumn(out, label).drop("__text")


def code_label(kind: Column, operation: Column, symbol: Column) -> Column:
    """Group from the panel's code columns: symbol table, then credit type, then operation."""
    code = _stripped(symbol)
    label = F.when(F.lit(False), "")
    for key, group in CODE_GROUPS.items():
        label = label.when(code == key, group)
    label = label.when(kind == "C", "income")
    for key, group in OPERATION_GROUPS.items():
        label = label.when(operation == key, group)
    return label.otherwise("other")


def first_non_blank(*cols: Column) -> Column:
    """First argument that is not blank after trimming; empty text if all are."""
    return F.coalesce(*[F.nullif(_stripped(c), F.lit("")) for c in cols], F.lit(""))


def operation_details(operation: Column, symbol: Column) -> Column:
    return F.concat_ws("|", F.coalesce(operation, F.lit("")), _stripped(symbol))


def merchant_key(counterparty: Column, details: Column) -> Column:
    """Stable merchant name: no digits, upper case, single blanks, at most 24 characters."""
    name = _stripped(counterparty)
    base = F.when(name != "", name).otherwise(F.coalesce(details, F.lit("")))
    bare = F.upper(F.regexp_replace(base, r"\p{Nd}", ""))
    return F.substring(F.btrim(F.regexp_replace(bare, r"[\s\p{Z}]+", " ")), 1, 24)


def group_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SPENDING_GROUPS.items()), "name string, description string")


def group_breakdown(tx: DataFrame) -> DataFrame:
    """Rows and total per spending group, most frequent first."""
    return (
        tx.groupBy("spending_group")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast("decimal(38,2)").alias("total"))
        .orderBy(F.desc("n"), "spending_group")
    )
