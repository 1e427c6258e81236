"""All public names in one place, under the names usual for such a framework.

Constructors that make plans on executors take the Spark session as their last argument.
"""

from __future__ import annotations

from types import SimpleNamespace

from tomolith.errors import BadCastError, Error, InvalidArgumentError, NotSettledError, OutOfRangeError
from tomolith.functions.columns import binom, factorial, heaviside, lerp, sign
from tomolith.functions.functionals import (
    ConstantFunctional, Constraint, EmissionLogLikelihood, Functional, FunctionalScalarMul, FunctionalSum, Huber, IndicatorBox, IndicatorNonNegativity, L0PseudoNorm, L1Norm, L2Reg, L2Squared,
    LeastSquares, LinearResidual, LInfNorm, PseudoHuber, Quadric, SeparableSum, TransmissionLogLikelihood, WeightedL1Norm, WeightedL2Squared, WeightedLeastSquares, ZeroFunctional,
)
from tomolith.functions.proximal import CombinedProximal, ProximalBoxConstraint, ProximalHuber, ProximalIdentity, ProximalL0, ProximalL1, ProximalL2Squared, ProximalMixedL21Norm, ProximalOperator
from tomolith.functions.proximal import prox_apply as proxapply
from tomolith.operators.basic import Dictionary, FiniteDifferences, JacobiPreconditioner
from tomolith.operators.fourier import FourierTransform, ShearletTransform, fft, ifft
from tomolith.operators.linear import BlockOperator as BlockLinearOperator
from tomolith.operators.linear import Identity, LinearOperator, Relation, Scaling, adjoint, leaf
from tomolith.operators.projectors import (
    BinaryMethod, BlobProjector, BlobVoxelProjector, BSplineProjector, BSplineVoxelProjector, JosephsMethod, PhaseContrastBlobVoxelProjector, PhaseContrastBSplineVoxelProjector, SiddonsMethod, SubsetSampler,
)
from tomolith.plans import geometry as _g
from tomolith.plans.descriptor import Grid as VolumeDescriptor
from tomolith.plans.descriptor import best_common as bestCommon
from tomolith.plans.descriptor import identical_blocks as IdenticalBlocksDescriptor
from tomolith.plans.descriptor import partition as PartitionDescriptor
from tomolith.plans.descriptor import random_blocks as RandomBlocksDescriptor
from tomolith.plans.geometry import CurvedDetector as CurvedDetectorDescriptor
from tomolith.plans.geometry import Detector as PlanarDetectorDescriptor
from tomolith.plans.geometry import Pose as Geometry
from tomolith.plans.solvers import (
    ABGMRES, ADMML2, APGD, BAGMRES, CGLS, CGNE, CGNL, FGM, FISTA, GMRES, ISTA, OGM, PGD, SIRT, SQS, GradientDescent, Landweber, LinearizedADMM, OrthogonalMatchingPursuit, Solver,
)
from tomolith.plans.solvers import power_iterations as powerIterations
from tomolith.plans.solvers import regularized_inversion as regularizedInversion
from tomolith.plans.timing import Timer, set_level
from tomolith.plans.vector import Vector as DataContainer
from tomolith.plans.vector import concatenate, lincomb
from tomolith.sources import files as _f
from tomolith.sources import phantoms as _p

FFTNorm = SimpleNamespace(FORWARD="forward", ORTHO="ortho", BACKWARD="backward")
FiniteDifferenceType = SimpleNamespace(FORWARD="forward", BACKWARD="backward", CENTRAL="central")
SamplingStrategy = SimpleNamespace(ROUND_ROBIN=_g.ROUND_ROBIN, ROTATIONAL_CLUSTERING=_g.ROTATIONAL_CLUSTERING)
CircleTrajectoryGenerator = SimpleNamespace(createTrajectory=_g.circle_trajectory, trajectoryFromAngles=_g.trajectory_from_angles)
CurvedCircleTrajectoryGenerator = SimpleNamespace(createTrajectory=_g.curved_circle_trajectory)
SphereTrajectoryGenerator = SimpleNamespace(createTrajectory=_g.sphere_trajectory)
LimitedAngleTrajectoryGenerator = SimpleNamespace(createTrajectory=_g.limited_angle_trajectory)
phantoms = SimpleNamespace(modifiedSheppLogan=_p.shepp_logan, smoothBlob=_p.smooth_blob, rectangle=_p.rectangle, circular=_p.circular, forbild=_p.forbild, rasterize=_p.rasterize, Solid=_p.Solid)
EllipseGenerator = SimpleNamespace(drawFilledEllipse2d=lambda image, amplitude, centre, half, angle=0.0: _p.draw_ellipses(image, [_p.Ellipse(amplitude, tuple(centre), tuple(half), angle)]))
NoNoise, GaussianNoise, PoissonNoise = _p.no_noise, _p.gaussian_noise, _p.poisson_noise
EDF = SimpleNamespace(read=_f.read_edf, write=_f.write_edf)
MHD = SimpleNamespace(read=_f.read_mhd, write=_f.write_mhd)
PGM = SimpleNamespace(write=_f.write_pgm)

__all__ = [name for name in dir() if not name.startswith("_") and name not in ("annotations", "SimpleNamespace")]
