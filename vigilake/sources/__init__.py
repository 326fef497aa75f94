"""Readers of source trees and captured exchanges."""
