"""Classification of tagged features: predicates over a map column, and the rule table of the 66-class vocabulary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: `class: condition` in order of class id. `/` separates alternatives, `+` joins conditions, `!` negates, `*k` asks for key k,
#: `k=a|b` for one of the values, `k~v` for a token, `@c` for another class.
RULES_66 = """
tennis: leisure=pitch + sport~tennis
skate_park: leisure=skate_park / leisure=pitch + sport~skateboard
american_football: leisure=pitch + sport~american_football
swimming_pool: leisure=swimming_pool
golf_course: leisure=golf_course
baseball_field: leisure=pitch + sport~baseball
stadium: leisure=stadium
roundabout: junction=roundabout
airport: aeroway=aerodrome
port: !@marina + landuse=port|harbour / !@marina + industrial=port
railway_station: railway=station / public_transport=station
runway: aeroway=runway
airport_hangar: aeroway=hangar / building=hangar
airport_terminal: aeroway=terminal / building=terminal
helipad: aeroway=helipad
dam: waterway=dam / man_made=dam
electric_substation: power=substation
shipyard: industrial=shipyard / man_made=shipyard + landuse=industrial / man_made=shipyard + *industrial / man_made=shipyard + *building
solar_farm: power=plant + plant:source=solar / power=generator + generator:source=solar
wind_farm: power=plant + plant:source=wind / power=generator + generator:source=wind / power=generator + generator:method=wind_turbine / man_made=wind_turbine
surface_mine: landuse=quarry
waste_disposal: landuse=landfill / amenity=waste_disposal
water_treatment_facility: man_made=wastewater_plant|water_works
marina: leisure=marina / harbour=marina / waterway=marina / *mooring
beach: natural=beach
parking_garage: amenity=parking + parking=multi-storey|underground
parking_lot: amenity=parking + parking=surface
soccer: leisure=pitch|sports_centre|stadium + sport~soccer
farmland: landuse=farmland
forest: landuse=forest / natural=wood
lake: water=lake
wetland: natural=wetland
park: leisure=park
river: waterway=river|riverbank / water=river
desert: natural=desert
meadow: landuse=meadow
bareland: natural=bare_rock|scree|shingle
chaparral: natural=scrub
industrial: landuse=industrial
aquaculture: landuse=aquaculture / man_made=fish_farm / *aquaculture
construction_site: landuse=construction
nature_reserve: leisure=nature_reserve / boundary=protected_area
school: amenity=school
university: amenity=university / building=university
hospital: amenity=hospital / healthcare=hospital
supermarket: shop=supermarket
shopping_mall: shop=mall / building=mall
warehouse: building=warehouse
office: building=office
religious_building: amenity=place_of_worship / building=church|mosque|cathedral|synagogue|temple|chapel|shrine
fire_station: amenity=fire_station
police_station: amenity=police
prison: amenity=prison / landuse=prison / building=prison
gas_station: amenity=fuel
barn: building=barn
car_dealership: shop=car / amenity=car_dealer
railroad: railway=rail|light_rail|subway|tram|narrow_gauge|monorail
highway: highway=motorway|trunk|primary|secondary|tertiary + !bridge=yes + !tunnel=yes + !junction=roundabout
overpass: bridge=yes + *highway / bridge=yes + *railway
viaduct: bridge=viaduct
tower: man_made=tower
toll_booth: barrier=toll_booth / highway=toll_gantry|toll_booth
tunnel_opening: tunnel=yes + *railway / tunnel=yes + highway=motorway|trunk|primary|secondary|tertiary
pond: water=pond
sand: natural=sand
cemetery: landuse=cemetery / amenity=grave_yard
"""

#: A feature without any of these keys is dropped before it is classified.
TAG_KEYS = (
    "leisure", "sport", "landuse", "natural", "water", "waterway", "wetland", "amenity", "shop", "building", "healthcare", "highway", "railway",
    "public_transport", "junction", "aeroway", "bridge", "tunnel", "barrier", "parking", "man_made", "industrial", "power", "plant:source",
    "generator:source", "generator:method", "harbour", "mooring", "aquaculture",
)
#: Separators of lists in a value, in the order in which they are tried.
SEPARATORS = (";", ",", "|", " ")


def value(tags: Column, key: str) -> Column:
    """The value of a tag; empty where the key is missing."""
    return F.coalesce(F.try_element_at(tags, F.lit(key)), F.lit(""))


def has_key(tags: Column, key: str) -> Column:
    return F.coalesce(F.map_contains_key(tags, key), F.lit(False))


def is_one_of(tags: Column, key: str, values: list[str]) -> Column:
    return value(tags, key).isin(values)


def has_token(raw: Column, token: str) -> Column:
    """The first separator that occurs cuts the value into parts, stripped of white space, one of which has to equal the token; without any, the token is searched for in the value."""
    found = F.instr(raw, token) > 0
    for s in reversed(SEPARATORS):
        parts = F.transform(F.split(raw, f"[{s}]"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
        found = F.when(F.instr(raw, s) > 0, F.array_contains(parts, token)).otherwise(found)
    return found


def whitelisted(tags: Column, keys: tuple[str, ...] = TAG_KEYS) -> Column:
    """Whether a feature has any of the keys; false for null or empty tags."""
    return F.coalesce(F.arrays_overlap(F.map_keys(tags), F.array(*map(F.lit, keys))), F.lit(False))


def class_names(rules: str = RULES_66) -> list[str]:
    return [line.split(":")[0] for line in rules.strip().splitlines()]


def conditions(tags: Column, rules: str = RULES_66) -> list[Column]:
    """One boolean column for each class."""
    table = dict(line.split(": ", 1) for line in rules.strip().splitlines())

    def term(t: str) -> Column:
        t = t.strip()
        if t.startswith("!"):
            return ~term(t[1:])
        if t.startswith("*"):
            return has_key(tags, t[1:])
        if t.startswith("@"):
            return rule(table[t[1:]])
        if "~" in t:
            key, token = t.split("~")
            return has_token(value(tags, key), token)
        key, values = t.split("=")
        return is_one_of(tags, key, values.split("|"))

    def rule(text: str) -> Column:
        out = None
        for alternative in text.split(" / "):
            both = None
            for t in alternative.split(" + "):
                both = term(t) if both is None else both & term(t)
            out = both if out is None else out | both
        return out

    return [rule(text) for text in table.values()]


def classify(tags: Column, rules: str = RULES_66) -> Column:
    """Ids of all classes that match, ascending."""
    return F.array_compact(F.array(*(F.when(c, F.lit(i)) for i, c in enumerate(conditions(tags, rules)))))
