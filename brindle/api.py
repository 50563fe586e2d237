"""The public names in one place."""

from .dataset import BinnedDataset, Dataset, accurate_sum, concat
from .functions.channel import Channel, ChannelError, Edge, Vertex, VertexFrame
from .functions.lineshape import blatt_weisskopf_barriers, breit_wigner, f_vector, k_matrix, kopf_a0, kopf_a2, kopf_f0, kopf_f2, kopf_pi1, kopf_rho, p_vector, relativistic_breit_wigner, relativistic_breit_wigner_custom
from .functions.quantum import PARTICLES, Isospin, PartialWave, Particle, RuleSet, SelectionRules
from .functions.special import WignerD, blatt_weisskopf, blatt_weisskopf_custom, chew_mandelstam, clebsch_gordan, q, rho, spherical_harmonic, wigner_3j
from .functions.vectors import RealVec3, RealVec4, Vec3, Vec4
from .model import Model
from .operators.binning import Bins
from .operators.cross_section import Axis, BinnedEstimate, CrossSection, Differential, Ensemble, Estimate, combine, combined_total
from .operators.draws import ColumnEstimate, FrameEnsemble
from .operators.fit import FitResult, bootstrap_fit, fit, fit_restarts, fit_stochastic, sample, walker_positions
from .operators.generate import Generator, InitialMomentum, MassProposal, ScalarSource, VertexProposal
from .operators.histogram import Histogram
from .operators.likelihood import NLL, CustomTerm, ExtendedNLL, LassoPenalty, Likelihood, Normalization, Projection, RidgePenalty
from .operators.predicate import Predicate, between
from .plans.expr import Expr, Parameter, acos, atan2, cis, complex_, dot, matmul, matrix, matrix_from_flat, matvec, parameter, polar_complex, scalar, solve, vector
from .plans.render import Style
from .schema import EventSchema, SchemaError
from .serde import from_json, to_json
from .session import Execution, MemoryBudget, capabilities
from .sources.memory import BatchBuilder, BatchSource, MemorySink, MemorySource
from .sources.parquet import ParquetSink, ParquetSource, read_parquet, write_parquet
from .sources.root import read_root

__all__ = [k for k in dir() if not k.startswith("_")]
