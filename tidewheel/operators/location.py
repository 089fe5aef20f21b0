"""Location classification by text, structured and description evidence."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.functions.text import blank, either, low_words, strip

# Places with their spellings, codes and countries.
REGIONS = {
    "Andhra Pradesh": ["andhra pradesh"],
    "Arunachal Pradesh": ["arunachal pradesh"],
    "Assam": ["assam"],
    "Bihar": ["bihar"],
    "Chhattisgarh": ["chhattisgarh", "chattisgarh"],
    "Goa": ["goa"],
    "Gujarat": ["gujarat"],
    "Haryana": ["haryana"],
    "Himachal Pradesh": ["himachal pradesh"],
    "Jharkhand": ["jharkhand"],
    "Karnataka": ["karnataka"],
    "Kerala": ["kerala"],
    "Madhya Pradesh": ["madhya pradesh"],
    "Maharashtra": ["maharashtra"],
    "Manipur": ["manipur"],
    "Meghalaya": ["meghalaya"],
    "Mizoram": ["mizoram"],
    "Nagaland": ["nagaland"],
    "Odisha": ["odisha", "orissa"],
    "Punjab": ["punjab"],
    "Rajasthan": ["rajasthan"],
    "Sikkim": ["sikkim"],
    "Tamil Nadu": ["tamil nadu", "tamilnadu"],
    "Telangana": ["telangana"],
    "Tripura": ["tripura"],
    "Uttar Pradesh": ["uttar pradesh"],
    "Uttarakhand": ["uttarakhand", "uttaranchal"],
    "West Bengal": ["west bengal"],
    "Andaman and Nicobar Islands": ["andaman and nicobar", "andaman nicobar"],
    "Chandigarh": ["chandigarh"],
    "Dadra and Nagar Haveli and Daman and Diu": ["dadra and nagar haveli", "daman and diu", "dadra nagar haveli"],
    "Delhi": ["national capital territory of delhi", "nct delhi", "delhi"],
    "Jammu and Kashmir": ["jammu and kashmir", "jammu kashmir"],
    "Ladakh": ["ladakh"],
    "Lakshadweep": ["lakshadweep"],
    "Puducherry": ["puducherry", "pondicherry"],
}
CITIES = {
    "Agra": ["agra"],
    "Ahmedabad": ["ahmedabad"],
    "Aizawl": ["aizawl"],
    "Ajmer": ["ajmer"],
    "Aligarh": ["aligarh"],
    "Alwar": ["alwar"],
    "Amaravati": ["amaravati"],
    "Amritsar": ["amritsar"],
    "Anand": ["anand"],
    "Aurangabad": ["aurangabad", "chhatrapati sambhajinagar"],
    "Bareilly": ["bareilly"],
    "Belagavi": ["belagavi", "belgaum"],
    "Bengaluru": ["bengaluru", "bangalore", "b lore"],
    "Bhopal": ["bhopal"],
    "Bhubaneswar": ["bhubaneswar", "bhubaneshwar"],
    "Bokaro": ["bokaro"],
    "Chandigarh": ["chandigarh"],
    "Chennai": ["chennai", "madras"],
    "Coimbatore": ["coimbatore"],
    "Cuttack": ["cuttack"],
    "Dehradun": ["dehradun"],
    "Delhi": ["new delhi", "delhi ncr", "delhi"],
    "Dhanbad": ["dhanbad"],
    "Dharamshala": ["dharamshala", "dharmshala"],
    "Durgapur": ["durgapur"],
    "Faridabad": ["faridabad"],
    "Gandhinagar": ["gandhinagar"],
    "Ghaziabad": ["ghaziabad"],
    "Greater Noida": ["greater noida"],
    "Gurugram": ["gurugram", "gurgaon"],
    "Guwahati": ["guwahati"],
    "Gwalior": ["gwalior"],
    "Hubballi": ["hubballi", "hubli"],
    "Hyderabad": ["hyderabad"],
    "Indore": ["indore"],
    "Jaipur": ["jaipur"],
    "Jalandhar": ["jalandhar"],
    "Jammu": ["jammu"],
    "Jamshedpur": ["jamshedpur"],
    "Jodhpur": ["jodhpur"],
    "Kanpur": ["kanpur"],
    "Kochi": ["kochi", "cochin"],
    "Kolhapur": ["kolhapur"],
    "Kolkata": ["kolkata", "calcutta"],
    "Kota": ["kota"],
    "Kozhikode": ["kozhikode", "calicut"],
    "Lucknow": ["lucknow"],
    "Ludhiana": ["ludhiana"],
    "Madurai": ["madurai"],
    "Mangaluru": ["mangaluru", "mangalore"],
    "Meerut": ["meerut"],
    "Mohali": ["mohali", "sas nagar", "s a s nagar"],
    "Mumbai": ["mumbai", "bombay"],
    "Mysuru": ["mysuru", "mysore"],
    "Nagpur": ["nagpur"],
    "Nashik": ["nashik", "nasik"],
    "Navi Mumbai": ["navi mumbai", "new bombay"],
    "Nellore": ["nellore"],
    "Noida": ["noida"],
    "Panaji": ["panaji", "panjim"],
    "Patna": ["patna"],
    "Prayagraj": ["prayagraj", "allahabad"],
    "Pune": ["pune", "poona"],
    "Raipur": ["raipur"],
    "Rajkot": ["rajkot"],
    "Ranchi": ["ranchi"],
    "Rohtak": ["rohtak"],
    "Salem": ["salem"],
    "Shillong": ["shillong"],
    "Siliguri": ["siliguri"],
    "Srinagar": ["srinagar"],
    "Surat": ["surat"],
    "Thane": ["thane"],
    "Thiruvananthapuram": ["thiruvananthapuram", "trivandrum"],
    "Tiruchirappalli": ["tiruchirappalli", "trichy"],
    "Tirupati": ["tirupati"],
    "Udaipur": ["udaipur"],
    "Vadodara": ["vadodara", "baroda"],
    "Varanasi": ["varanasi", "banaras", "benares"],
    "Vijayawada": ["vijayawada"],
    "Visakhapatnam": ["visakhapatnam", "vizag", "vishakhapatnam"],
    "Warangal": ["warangal"],
}
LOCALITIES = {
    "Bengaluru": ["whitefield", "electronic city", "manyata tech park", "manyata embassy business park", "bellandur", "marathahalli", "koramangala", "hsr layout", "sarjapur road"],
    "Hyderabad": ["gachibowli", "hitec city", "hi tech city", "madhapur", "kondapur", "financial district hyderabad", "nanakramguda"],
    "Gurugram": ["dlf cyber city", "cyber hub gurgaon", "udyog vihar", "golf course road gurgaon", "sohna road gurgaon"],
    "Mumbai": ["powai", "andheri", "goregaon", "bandra kurla complex", "bkc mumbai"],
    "Navi Mumbai": ["airoli", "ghansoli"],
    "Pune": ["hinjawadi", "hinjewadi", "kharadi", "magarpatta", "viman nagar", "yerawada", "yerwada"],
    "Kochi": ["infopark kochi", "smartcity kochi"],
    "Thiruvananthapuram": ["technopark trivandrum", "technopark thiruvananthapuram"],
    "Kolkata": ["new town kolkata", "sector v kolkata", "salt lake kolkata"],
}
OFFICE_CODES = {
    "BLR": "Bengaluru",
    "BGLR": "Bengaluru",
    "HYD": "Hyderabad",
    "DEL": "Delhi",
    "BOM": "Mumbai",
    "MUM": "Mumbai",
    "MAA": "Chennai",
    "CHE": "Chennai",
    "PNQ": "Pune",
    "CCU": "Kolkata",
    "KOL": "Kolkata",
    "AMD": "Ahmedabad",
    "COK": "Kochi",
    "TRV": "Thiruvananthapuram",
    "CJB": "Coimbatore",
    "GGN": "Gurugram",
    "JAI": "Jaipur",
    "IDR": "Indore",
    "NAG": "Nagpur",
    "GOI": "Goa",
    "IXC": "Chandigarh",
    "LKO": "Lucknow",
    "BBI": "Bhubaneswar",
    "GAU": "Guwahati",
    "VTZ": "Visakhapatnam",
    "VGA": "Vijayawada",
    "PAT": "Patna",
    "RPR": "Raipur",
    "RNC": "Ranchi",
}
STATE_CODES = {
    "AP": "Andhra Pradesh",
    "AR": "Arunachal Pradesh",
    "AS": "Assam",
    "BR": "Bihar",
    "CG": "Chhattisgarh",
    "GA": "Goa",
    "GJ": "Gujarat",
    "GUJ": "Gujarat",
    "HR": "Haryana",
    "HP": "Himachal Pradesh",
    "JH": "Jharkhand",
    "KA": "Karnataka",
    "KAR": "Karnataka",
    "KL": "Kerala",
    "MP": "Madhya Pradesh",
    "MH": "Maharashtra",
    "MN": "Manipur",
    "ML": "Meghalaya",
    "MZ": "Mizoram",
    "NL": "Nagaland",
    "OD": "Odisha",
    "OR": "Odisha",
    "PB": "Punjab",
    "RJ": "Rajasthan",
    "SK": "Sikkim",
    "TN": "Tamil Nadu",
    "TS": "Telangana",
    "TG": "Telangana",
    "TR": "Tripura",
    "UP": "Uttar Pradesh",
    "WB": "West Bengal",
    "AN": "Andaman and Nicobar Islands",
    "CH": "Chandigarh",
    "DL": "Delhi",
    "JK": "Jammu and Kashmir",
    "LA": "Ladakh",
    "LD": "Lakshadweep",
    "PY": "Puducherry",
}
FOREIGN = [
    "united states", "united states of america", "usa", "canada", "united kingdom", "great britain", "england", "scotland", "wales",
    "singapore", "australia", "new zealand", "germany", "france", "ireland", "netherlands", "spain", "italy", "portugal", "sweden",
    "norway", "denmark", "finland", "switzerland", "austria", "belgium", "poland", "romania", "czech republic", "czechia", "hungary",
    "ukraine", "israel", "united arab emirates", "uae", "saudi arabia", "qatar", "bahrain", "oman", "pakistan", "bangladesh", "nepal",
    "sri lanka", "bhutan", "maldives", "afghanistan", "japan", "south korea", "korea", "china", "hong kong", "taiwan", "malaysia",
    "indonesia", "philippines", "thailand", "vietnam", "brazil", "mexico", "argentina", "chile", "colombia", "south africa", "kenya",
    "nigeria", "egypt",
]
DESCRIPTION_PHRASES = [
    r"\b(?:position|role|job) (?:is )?based in india\b",
    r"\bindia based (?:position|role|job|team)\b",
    r"\bremote (?:within|in|from) india\b",
    r"\bwork remotely (?:within|from) india\b",
    r"\b(?:candidates|applicants) (?:must be )?(?:located|based|resident) in india\b",
    r"\bopen to (?:candidates|applicants) (?:located|based) in india\b",
    r"\bwork location india\b",
]
LOCATION_KEYS = ["location", "country", "city", "state", "province", "region", "office", "address", "workplace", "place"]
COUNTRY_KEYS = ["country", "countrycode", "countryid"]
STATE_KEYS = ["state", "province", "region"]


def spelled(names: dict[str, list[str]]) -> list[tuple[str, str]]:
    """(spelling, name) pairs, the one to prefer first: the longest, and of those the last name."""
    return sorted(((s, name) for name, spellings in names.items() for s in spellings), key=lambda p: (len(p[0]), p[1]), reverse=True)


def _pairs(rows) -> Column:
    """A constant array of (a, n), parsed at once."""
    return F.expr("array(" + ", ".join(f"named_struct('a', '{a}', 'n', '{n}')" for a, n in rows) + ")")


def _words(rows) -> Column:
    return F.expr("array(" + ", ".join(f"'{x}'" for x in rows) + ")")


def plain(c: Column) -> Column:
    """Lower-case words of a-z and 0-9 with single spaces, and one at either end."""
    return F.concat(F.lit(" "), F.trim(low_words(F.replace(blank(c), F.lit("&"), F.lit(" and ")))), F.lit(" "))


def _first_of(padded: Column, table: dict[str, list[str]]) -> Column:
    return F.get(F.filter(_pairs((f" {a} ", n) for a, n in spelled(table)), lambda r: F.contains(padded, r["a"])), 0)["n"]


def explicit_india(c: Column, padded: Column | None = None) -> Column:
    """padded: the text's plain words, where they are at hand."""
    padded, bare = plain(c) if padded is None else padded, strip(blank(c))
    named = padded.contains(" india ") | padded.contains(" bharat ")
    return named | F.upper(bare).isin("IN", "IND") | bare.rlike(r"(?i)^(?:remote\s*[-,/|:]\s*(?:IN|IND)|(?:IN|IND)\s*[-,/|:]\s*remote)$")


def explicit_foreign(c: Column, padded: Column | None = None) -> Column:
    """The first foreign country named, if India isn't, else null."""
    padded = plain(c) if padded is None else padded
    found = F.get(F.filter(_words(FOREIGN), lambda r: F.contains(padded, F.concat(F.lit(" "), r, F.lit(" ")))), 0)
    return F.when(~explicit_india(c, padded), found)


def _code_of(c: Column) -> Column:
    """The place of the first office code among a text's runs of A-Z and 0-9."""
    runs = F.concat(F.lit(" "), F.regexp_replace(blank(c), "[^A-Z0-9]+", " "), F.lit(" "))
    return F.get(F.filter(_pairs((f" {code} ", n) for code, n in OFFICE_CODES.items()), lambda r: F.contains(runs, r["a"])), 0)["n"]


def with_place(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Adds {prefix}pad, india, foreign, place and why for a text column, in stages that Catalyst keeps apart."""
    n = lambda x: f"{prefix}{x}"
    df = df.withColumns({n("pad"): plain(F.col(column)), n("india"): explicit_india(F.col(column))})
    pad, india = F.col(n("pad")), F.col(n("india"))
    abroad = F.get(F.filter(_words(FOREIGN), lambda r: F.contains(pad, F.concat(F.lit(" "), r, F.lit(" ")))), 0)
    df = df.withColumns({n("city"): _first_of(pad, CITIES), n("region"): _first_of(pad, REGIONS), n("local"): _first_of(pad, LOCALITIES), n("code"): _code_of(F.col(column)), n("foreign"): F.when(~india, abroad)})
    city, region, local, code = (F.col(n(x)) for x in ("city", "region", "local", "code"))
    remote = pad.contains("remote")
    place = F.when(pad == "  ", None).when(india & remote, "Remote").when(india, F.coalesce(city, region, F.lit("India"))).otherwise(F.coalesce(city, region, local, code))
    named = F.when(remote | (city.isNull() & region.isNull()), "country_name_or_code").when(city.isNotNull(), "country+city").otherwise("country+region")
    why = F.when(pad == "  ", None).when(india, named).when(city.isNotNull(), "city").when(region.isNotNull(), "region").when(local.isNotNull(), "tech_locality").when(code.isNotNull(), "office_code")
    return df.withColumns({n("place"): place, n("why"): why}).drop(n("city"), n("region"), n("local"), n("code"))


def _has_place(c: Column, padded: Column) -> Column:
    """Whether a text, with its plain words, names an Indian place and no other country; for the elements of an array."""
    every = _words(f" {a} " for t in (CITIES, REGIONS, LOCALITIES) for a, _ in spelled(t))
    return explicit_india(c, padded) | (explicit_foreign(c, padded).isNull() & (F.exists(every, lambda a: F.contains(padded, a)) | _code_of(c).isNotNull()))


def with_description_place(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Adds {prefix}place and why: from the first location line, of 120, that names a place, or from a strong phrase."""
    told = F.when(F.col(column).rlike("(?i)location"), F.col(column))  # a label has this word
    lines = F.slice(F.filter(F.transform(F.split(blank(told), r"\R"), strip), lambda x: x != ""), 1, 120)
    label = r"(?i)\b(?:job\s+|work\s+|workplace\s+|office\s+|primary\s+)?location\s*[:\-]"
    values = F.transform(F.filter(lines, lambda x: x.rlike(label)), lambda x: strip(F.regexp_replace(x, r"^[^:\-]*[:\-]", "")))
    value, text = f"{prefix}value", f"{prefix}text"
    # plain words are made once a line, not once for each name looked up; each strong phrase has the word india
    values = F.transform(values, lambda x: F.struct(x.alias("line"), plain(x).alias("pad")))
    df = df.withColumns({value: values, text: plain(F.when(F.col(column).rlike("(?i)india"), F.col(column)))}).withColumn(value, F.get(F.filter(F.col(value), lambda x: _has_place(x["line"], x["pad"])), 0)["line"])
    df = with_place(df, value, f"{prefix}v_")
    strong = either(F.col(text).rlike(p) for p in DESCRIPTION_PHRASES)
    found = F.col(f"{prefix}v_place")
    df = df.withColumns(
        {
            f"{prefix}place": F.coalesce(found, F.when(strong, F.when(F.col(text).contains("remote"), "Remote").otherwise("India"))),
            f"{prefix}why": F.when(found.isNotNull(), F.concat(F.lit("description_location:"), f"{prefix}v_why")).when(strong, "description_strong_india"),
        }
    )
    return df.drop(value, text, *(f"{prefix}v_{x}" for x in ("pad", "india", "foreign", "place", "why")))


def _walk(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, ord, path, value) of the scalars under location-like keys, in document order, five levels deep."""
    for pdf in rows:
        out: list[tuple] = []

        def visit(key, value, path, depth, out=out):
            if depth > 5:
                return
            named = isinstance(value, dict)
            for name, child in value.items() if named else enumerate(value):
                here = f"{path}.{name}" if named else f"{path}[{name}]"
                bare = "".join(ch for ch in str(name).lower() if ch.isalnum())
                if named and isinstance(child, (str, int, float)) and any(h in bare for h in LOCATION_KEYS):
                    out.append((key, len(out), here, str(child)))
                if isinstance(child, (dict, list)):
                    visit(key, child, here, depth + 1)

        for key, raw in zip(pdf["key"], pdf["raw"], strict=True):
            try:
                value = json.loads(raw) if raw else None
            except ValueError:
                continue
            if isinstance(value, (dict, list)):
                visit(key, value, "raw", 0)
        yield pd.DataFrame(out, columns=["key", "ord", "path", "value"])


def structured_values(payloads: DataFrame, key: str, raw: str) -> DataFrame:
    return payloads.select(F.col(key).cast("string").alias("key"), F.col(raw).alias("raw")).where("raw is not null").mapInPandas(_walk, "key string, ord long, path string, value string")


def structured_evidence(values: DataFrame) -> DataFrame:
    """(key, country_status, country_evidence, place, place_evidence) for each payload with location values."""
    path = F.regexp_replace(F.lower("path"), "[^a-z0-9]+", "")
    in_country = either(path.contains(k) for k in COUNTRY_KEYS)
    in_state = either(path.contains(k) for k in STATE_KEYS)
    values = with_place(values, "value", "v_")
    upper, foreign, padded = F.upper(strip(F.col("value"))), F.col("v_foreign"), F.col("v_pad")
    state = F.get(F.filter(_pairs(STATE_CODES.items()), lambda r: r["a"] == upper), 0)["n"]
    says_india = in_country & (upper.isin("IN", "IND", "INDIA") | padded.contains(" india ") | padded.contains(" bharat "))
    by_code = upper.rlike("^[A-Z]{2,3}$")
    rows = values.select(
        "key",
        "ord",
        F.when(says_india, F.concat("path", F.lit("=india"))).alias("india"),
        F.when(in_country & ~says_india, F.when(foreign.isNotNull(), F.concat("path", F.lit("="), foreign)).when(by_code, F.concat("path", F.lit("=country_code:"), upper))).alias("foreign"),
        F.when(~in_country & in_state & state.isNotNull(), F.struct(state.alias("place"), F.concat("path", F.lit("=state_code:"), upper).alias("evidence")))
        .when(~in_country & foreign.isNull() & F.col("v_place").isNotNull(), F.struct(F.col("v_place").alias("place"), F.concat("path", F.lit(":"), "v_why").alias("evidence")))
        .alias("found"),
    )
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ord")))
    best = rows.groupBy("key").agg(last("india").alias("india"), last("foreign").alias("foreign"), F.min_by("found", F.when(F.col("found").isNotNull(), F.col("ord"))).alias("found"))
    return best.select(
        "key",
        F.when(F.col("india").isNotNull(), "india").when(F.col("foreign").isNotNull(), "foreign").alias("country_status"),
        F.coalesce("india", "foreign").alias("country_evidence"),
        F.col("found.place").alias("place"),
        F.col("found.evidence").alias("place_evidence"),
    )


def classify(df: DataFrame, location: str = "location", description: str = "description", structured: bool = False, prefix: str = "location_") -> DataFrame:
    """Adds {prefix}status, country_code, normalized and evidence. With ``structured``, df has structured_evidence's columns."""
    df = with_description_place(with_place(df, location, "_t_"), description, "_d_")
    null = F.lit(None).cast("string")
    country, evidence, place, why = (F.col(x) if structured else null for x in ("country_status", "country_evidence", "place", "place_evidence"))
    india, foreign, shown_place, shown_why = (F.col(f"_t_{x}") for x in ("india", "foreign", "place", "why"))
    told, told_why = F.col("_d_place"), F.col("_d_why")
    vague = F.trim("_t_pad").isin("remote", "anywhere", "global", "worldwide", "multiple locations", "various locations")
    # the first rule that holds, by number: country field, country in text, foreign in text, place, field, description
    rule = F.when(country == "foreign", 1).when(country == "india", 2).when(india, 3).when(foreign.isNotNull(), 4).when(shown_place.isNotNull(), 5).when(place.isNotNull(), 6).when(told.isNotNull(), 7).otherwise(8)
    df = df.withColumn("_rule", rule)
    rule = F.col("_rule")
    chosen = F.when(rule.isin(2, 3, 5), F.coalesce(shown_place, F.lit("India"))).when(rule == 6, place).when(rule == 7, told)
    df = df.withColumn("_chosen", chosen)
    chosen, at = F.col("_chosen"), lambda x: F.concat(F.lit("location:"), x)
    full = F.when(chosen == "Remote", "Remote, India").when(chosen == "India", "India").otherwise(F.concat(chosen, F.lit(", India")))
    df = df.withColumns(
        {
            f"{prefix}status": F.when(rule.isin(1, 4), "foreign").when(rule == 8, "unknown").otherwise("india"),
            f"{prefix}country_code": F.when(rule.isin(2, 3, 5, 6, 7), "IN"),
            f"{prefix}normalized": F.when(chosen.isNotNull(), full).otherwise(F.coalesce(F.nullif(strip(F.col(location)), F.lit("")), F.lit("Unknown"))),
            f"{prefix}evidence": F.when(rule.isin(1, 2), evidence).when(rule.isin(3, 5), at(F.coalesce(shown_why, F.lit("country")))).when(rule == 4, at(foreign)).when(rule == 6, why).when(rule == 7, told_why).when(vague, "remote_or_global_without_country").otherwise("no_positive_india_evidence"),
        }
    )
    return df.drop("_rule", "_chosen", *(f"_t_{x}" for x in ("pad", "india", "foreign", "place", "why")), "_d_place", "_d_why")
