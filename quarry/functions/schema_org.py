"""The most specific schema.org type of a page's JSON-LD."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, filled

#: Known types, the most specific first.
SPECIFICITY = (
    "Dentist Physician Hospital Pharmacy MedicalClinic LegalService Attorney Notary Restaurant CafeOrCoffeeShop Bakery BarOrPub FastFoodRestaurant Brewery RealEstateAgent BankOrCreditUnion InsuranceAgency "
    "AccountingService FinancialService ClothingStore ElectronicsStore JewelryStore GroceryStore FurnitureStore PetStore ShoeStore SportingGoodsStore HardwareStore HomeGoodsStore BeautySalon HairSalon NailSalon "
    "DaySpa Electrician Plumber RoofingContractor GeneralContractor HVACBusiness TravelAgency Hotel LodgingBusiness CollegeOrUniversity School EducationalOrganization Course NewsMediaOrganization "
    "SoftwareApplication WebApplication MobileApplication IndividualProduct Product MedicalOrganization Store ProfessionalService LocalBusiness Organization WebSite"
).split()


def types_of(document: str) -> list[str]:
    """All ``@type`` values of a JSON document, through lists and ``@graph``; none if it is no JSON."""
    try:
        stack = [json.loads(document)]
    except (ValueError, RecursionError):
        return []
    found = []
    while stack:
        node = stack.pop()
        if isinstance(node, list):
            stack.extend(node)
        elif isinstance(node, dict):
            kind = node.get("@type")
            found += [k for k in (kind if isinstance(kind, list) else [kind]) if isinstance(k, str)]
            stack.append(node.get("@graph"))
    return found


def schema_type(html: str | Column) -> Column:
    """The most specific known type in a page, else empty.

    Scripts are cut out natively; only they are handed to Arrow batches, as no
    built-in walks JSON of unknown depth.
    """
    @F.pandas_udf("string")
    def best(scripts: pd.Series) -> pd.Series:
        rank = {name: i for i, name in enumerate(SPECIFICITY)}
        out = []
        for documents in scripts:
            known = sorted(rank[t] for d in (documents if documents is not None else ()) for t in types_of(d) if t in rank)
            out.append(SPECIFICITY[known[0]] if known else "")
        return pd.Series(out)

    return best(F.regexp_extract_all(filled(col(html)), F.lit("(?is)<script[^>]+application/ld\\+json[^>]*>(.*?)</script>"), 1))
