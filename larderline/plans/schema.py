"""Column names of a diary; every job takes them as an argument."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Diary:
    person: str = "seriali"
    year: str = "SurveyYear"
    day: str = "DayNo"
    age: str = "AgeR"
    sex: str = "Sex"
    country: str = "Country"
    food: str = "FoodName"
    food_no: str = "FoodNumber"
    sub: str = "SubFoodGroupCode"
    sub_desc: str = "SubFoodGroupDesc"
    main: str = "MainFoodGroupCode"
    main_desc: str = "MainFoodGroupDesc"
    grams: str = "TotalGrams"
    protein: str = "Proteing"
    energy: str = "Energykcal"
    diet: str = "Overall_Diet"
    reported: str = "Veg"
    weight: str = "Weight"

    @property
    def row_keys(self) -> list[str]:
        """What makes a diary row: one food on one day of one person."""
        return [
            self.person,
            self.year,
            self.day,
            self.age,
            self.sex,
            self.country,
            self.food,
            self.food_no,
            *self.groups,
        ]

    @property
    def groups(self) -> list[str]:
        return [self.main, self.main_desc, self.sub, self.sub_desc]

    @property
    def person_day(self) -> list[str]:
        return [self.person, self.day, self.age, self.sex]


DIARY = Diary()
