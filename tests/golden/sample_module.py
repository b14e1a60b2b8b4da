"""A hand-written module exercising every metadata-extraction rule."""

from abc import ABC, abstractmethod
from dataclasses import dataclass
from typing import Callable, Dict, Generic, List, Optional, Protocol, Tuple, TypeVar, Union

T = TypeVar("T")


class Shape(ABC):
    """Interface by base class."""

    @abstractmethod
    def area(self) -> float:
        pass

    def describe(self, prefix: str):
        return "shape"


class Walker(Protocol):
    def walk(self, steps: int) -> None: ...


class Marked:
    """Interface by decorator only."""

    @abstractmethod
    def mark(self, tag):
        pass


@dataclass
class Point:
    x: float
    y: float
    label: Optional[str] = None
    tags: List[str] = None
    count = 0

    def norm(self) -> float:
        return (self.x**2 + self.y**2) ** 0.5

    async def fetch(self) -> None:
        return None

    class Inner:
        z: int

        def hidden(self) -> int:
            return 1


class Box(Generic[T]):
    item: "T"
    lookup: Dict[str, List[int]]

    def put(self, item: T) -> "Box[T]":
        self.item = item
        return self

    def get(self) -> T:
        return self.item


def outer(a: int, b: int) -> int:
    def inner(c):
        return c * 2

    return inner(a) + b


def long_signature(
    first: int,
    second: str,
) -> Tuple[int, str]:
    return first, second


def either(flag: bool) -> Union[str, List[str]]:
    if flag:
        return "x"
    return ["x"]


def pick(items: List[T], pred: Callable[[T], bool]) -> Optional[T]:
    for it in items:
        if pred(it):
            return it
    return None


def inferred(x):
    if x:
        return x
    elif x is None:
        return None
    return 3


def nothing():
    pass


def modern(x: int | None, y: "Point") -> dict[str, int]:
    return {}


def one_liner(v): return v


async def not_collected(x: int) -> int:
    return x
