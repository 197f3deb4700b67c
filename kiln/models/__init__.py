from kiln.models.nets import MLP, LinearNet, SmallCNN, build_model
from kiln.models.optim import SGD, Adam, make_optimizer

__all__ = ["MLP", "LinearNet", "SmallCNN", "build_model", "SGD", "Adam", "make_optimizer"]
