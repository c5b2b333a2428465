"""Bundle text formats and their registry."""

from sheaf.profiles.base import Profile, ProfileRegistry, default_registry
from sheaf.profiles.fence import FenceProfile
from sheaf.profiles.plain import PlainProfile

__all__ = ["FenceProfile", "PlainProfile", "Profile", "ProfileRegistry", "default_registry"]
