"""Agent-based simulation on graphs, as DataFrames.

Populations and networks are tables, behaviour is column expressions, and a
simulation is a loop of declarative plans, one per tick.
"""

from .plans.breed import Breed
from .plans.context import get_neighbor, get_num_neighbors
from .plans.model import Model
from .plans.space import NetworkSpace, Space

__all__ = ["Breed", "Model", "NetworkSpace", "Space", "get_neighbor", "get_num_neighbors"]
__version__ = "0.1.0"
