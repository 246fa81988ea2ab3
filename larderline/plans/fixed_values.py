"""Word lists, codes, column names and limits that the results depend on.

Everything here is data of the survey and of the published report definitions, kept as plain
text in one place. Nothing is derived.
"""

from __future__ import annotations

from larderline.operators.cohorts import Band, CohortRule

# --- Fixed values: diet keywords, matched anywhere in the text, ignoring case ---------------

MEAT_GROUPS = [
    "BACON AND HAM",
    "BEEF VEAL AND DISHES",
    "BURGERS AND KEBABS",
    "CHICKEN AND TURKEY DISHES",
    "COATED CHICKEN",
    "LAMB AND DISHES",
    "LIVER AND DISHES",
    "MEAT PIES AND PASTRIES",
    "OTHER MEAT AND MEAT PRODUCTS",
    "PORK AND DISHES",
    "SAUSAGES",
]

MEAT_FOODS = [
    "CHICKEN",
    "LAMB",
    "BEEF",
    "PORK",
    "QUICHE, MEAT BASED",
]

FISH_GROUPS = [
    "OILY FISH",
    "OTHER WHITE FISH SHELLFISH & FISH DISHES",
    "WHITE FISH COATED OR FRIED",
]

FISH_FOODS = [
    "COD LIVER OIL",
    "FISH OIL",
    "FISH",
    "FOREVER ARTIC SEA",
    "OMEGA 3",
]

DAIRY_EGG_GROUPS = [
    "EGGS AND EGG DISHES",
    "YOGURT",
]

DAIRY_EGG_FOODS = [
    "MILK SEMI-SKIMMED PASTEURISED WINTER",
    "MILK SKIMMED PASTEURISED WINTER",
    "CHEESE CHEDDAR ENGLISH",
    "CHEESE CHEDDAR IRISH",
    "CHEESE CHEDDAR ANY OTHER OR FOR RECIPES",
    "CHEESE PARMESAN",
    "CHEESE LEICESTERSHIRE",
    "CHEESE HALLOUMI",
    "CHEESE GRUYERE",
    "CHEESE MASCARPONE",
    "CHEESE FETA",
    "RICOTTA",
    "PANEER",
    "CHEESE PROCESSED SLICES OR BLOCKS",
    "CHEESE SPREADS, TRIANGLES, PLAIN, DAIRYLEA ONLY",
    "CHEESE DOUBLE GLOUCESTER",
    "MACARONI CHEESE",
    "CHEESECAKE",
    "CHEESE SOFT FULL FAT SOFT CHEESE - PHILADELPHIA TYPE",
    "CHEESE SOFT MEDIUM FAT",
    "CHEESE SOFT LOW FAT",
    "CHEESE OR CHEESE AND TOMATO PIZZA WITH VEGS AND/OR FRUIT. NO MEAT, NO FISH, WITH ANY BASE, RETAIL",
    "CHEESE MOZZARELLA",
    "CHEESE CREAM FULLFAT",
    "GOATS CHEESE",
    "YOGURT LOW FAT",
    "YOGURT , WHOLE MILK, NATURAL, UNSWEETENED",
    "YOGURT, FULL FAT",
    "CHEESE AND TOMATO PIZZA",
    "ICE CREAM",
    "ICECREAM",
    "ICE-CREAM",
    "CREAM DOUBLE",
    "CREAM SINGLE PASTEURISED",
    "EGG",
    "WHEY PROTEIN",
    "WHEY POWDER",
    "YOGURT",
]

# --- Fixed values: diet classes, strongest first, and the flag that gives each --------------

DIETS = ["Neither", "Pescatarian", "Vegetarian", "Vegan"]

DIET_CASES = [
    ("Consumed_Meat", "Neither"),
    ("Consumed_Fish", "Pescatarian"),
    ("Consumed_DairyEgg", "Vegetarian"),
]

# --- Fixed values: nutrition-product code and keywords --------------------------------------

NUTRITION_PRODUCTS = "50E"

POWDER_WORDS = [
    "dry",
    "PROTEIN POWDER",
    "MEAL REPLACEMENT MILKSHAKE POWDER",
    "MEAL REPLACEMENT POWDER",
    "POWDER ONLY",
    "COMPLAN",
    "whey",
    "METAGENICS ULTRAINFLAMX",
    "SHAKE POWDER",
    "FYBOGEL",
    "CAMBRIDGE WEIGHT PLAN CHOCOLATE SHAKE FORTIFIED",
    "LIGHTER LIFE TOTAL BALANCE SOUP POWDER FORTIFIED",
]

DRINK_WORDS = [
    "liquid",
    "PROTEIN SHAKE",
    "shakes",
    "DUNN'S RIVER NURISHMENT",
    "ENSURE",
    "MEAL REPLACEMENT DRINK",
    "ENERGY DRINK",
    "INFATRINI",
]

BAR_WORDS = ["BARS"]

PRODUCT_CASES = [("nutrition_powders", "Powders"), ("nutrition_drinks", "Drinks")]
PRODUCT_DEFAULT = "Bars"

# --- Fixed values: nutrient columns ---------------------------------------------------------

# Amino acids with a digestibility coefficient: (short name, content column, coefficient column).
DIGESTIBLE = [
    ("TRP", "TRPg", "TRP_COEF"),
    ("THR", "THRg", "THR_COEF"),
    ("ILE", "ILEg", "ILE_COEF"),
    ("LEU", "LEUg", "LEU_COEF"),
    ("LYS", "LYSg", "LYS_COEF"),
    ("MET", "METg", "MET_COEF"),
    ("CYS", "CYSg", "CYS_COEF"),
    ("PHE", "PHEg", "PHE_COEF"),
    ("TYR", "TYRg", "TYR_COEF"),
    ("VAL", "VALg", "VAL_COEF"),
    ("ARG", "ARGg", "ARG_COEF"),
    ("HIST", "HISTNg", "HIS_COEF"),
]

# Content columns without a coefficient; the last one is too sparse to be required.
CONTENT_ONLY = ["ALAg", "ASPg", "GLUg", "GLYg", "PROg", "SERg", "HYPg"]
SPARSE_CONTENT = "HYPg"

MATCH_NUMBERS = ["Avg_protein", "Avg_water", "Avg_Zn", "Avg_Lys", "Avg_Tryp"]

MATCH_COLUMNS = [
    "Sr_no",
    "MainFoodGroupCode",
    "MainFoodGroupDesc",
    "SubFoodGroupCode",
    "SubFoodGroupDesc",
    "TotalGrams",
    "Proteing",
    "Protein_g100g",
    *MATCH_NUMBERS,
]

# Digestibility file: columns that belong to the matching work, then those of the food list.
DIGEST_MATCHING = [
    "USDA_item description",
    "NDB no",
    "FDC Id",
    "Avg_protein, g/100g_USDA",
    "Water, g",
    "Zn_mg",
    "Lys._g",
    "Tryp_g",
    "Avg Protein Diff",
    "% Diff",
    *MATCH_NUMBERS,
]

DIGEST_FOOD_LIST = [
    "Sr_no",
    "MainFoodGroupCode",
    "MainFoodGroupDesc",
    "SubFoodGroupDesc",
    "TotalGrams",
    "Proteing",
    "Protein_g100g",
]

LOOKUP_IDS = ["NDB no", "FDC Id"]

PRODUCT_NUTRIENTS = ["Energykcal", "EnergykJ", "Proteing", "Fatg", "Carbohydrateg", "Waterg"]

# 1-based positions of the nutrient columns in a diary file.
MEASURE_POSITIONS = (24, 81)

# --- Fixed values: cohorts of the intake report (sex 1 = male, 2 = female; kcal per day) -----


def _open(low: float | None, high: float | None) -> Band:
    return Band(low, high, low_closed=False, high_closed=False)


INTAKE_COHORTS = [
    CohortRule("adult male", 1, _open(18, 65), Band(800)),
    CohortRule("adult female", 2, _open(18, 65), Band(500)),
    CohortRule("older female", 2, _open(64, None), _open(500, 3500)),
    CohortRule("older male", 1, _open(64, None), _open(800, 4000)),
    CohortRule("infants", None, _open(None, 4)),
    CohortRule("children", None, Band(4, 10), _open(250, 2500)),
    CohortRule("adolescent male", 1, _open(10, 19), Band(500, 3500)),
    CohortRule("adolescent female", 2, Band(11, 18), Band(500, 3500)),
]

WEIGHT_BANDS = [
    CohortRule("adult male", 1, _open(18, 65)),
    CohortRule("adult female", 2, _open(18, 65)),
    CohortRule("older male", 1, _open(64, None)),
    CohortRule("older female", 2, _open(64, None)),
    CohortRule("infants", None, _open(None, 4)),
    CohortRule("children", None, _open(3, 11)),
    CohortRule("adolescent male", 1, _open(10, 19)),
    CohortRule("adolescent female", 2, _open(10, 19)),
]

PROTEIN_CHECKS = [
    CohortRule("adult male", 1, Band(19, 64), Band(800)),
    CohortRule("adult female", 2, Band(19, 64), Band(500)),
    CohortRule("older male", 1, Band(65), Band(800)),
    CohortRule("older female", 2, Band(65), Band(500)),
]

NOT_MEASURED = [-1]
